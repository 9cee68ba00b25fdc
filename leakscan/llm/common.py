"""Pieces that several operators share: words, reading tables, tables in the shared folder, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def blank_words(c: Column) -> Column:
    """Words between blanks (space and the controls 9 to 13); null and blank texts give an empty array."""
    spaced = F.coalesce(c, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, as the session names it. A local session that names none gets a folder of this
    machine; on a cluster that would lose data, so there the setting is required."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "leakscan-shared")
    return where.rstrip("/")


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(batch), rows):
        yield batch.slice(i, rows)


def give_back() -> None:
    """Returns memory that this Python worker has freed but kept: workers wait for later tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back after each batch it has read and in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                give_back()

        yield from work(each())
        give_back()

    return run


_made: list[list[str]] = []  # paths made by the running tidied() calls, the innermost last


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Writes the (small) result of a function of a DataFrame and deletes the tables that the function wrote on its way."""

    @wraps(make)
    def run(df: DataFrame, *args: object, **options: object) -> DataFrame:
        spark, result = df.sparkSession, []
        _made.append([])
        try:
            out = make(df, *args, **options)
            steps, _made[-1] = _made[-1], result
            out = written(out, make.__name__)
            result, _made[-1] = _made[-1], steps
            return out
        finally:
            for path in _made.pop():
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            if _made:
                _made[-1].extend(result)

    return run


def fresh_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of that name in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df by name, also with dots and back ticks in it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def without(docs: DataFrame, gone: DataFrame, keys: list[str], broadcast_rows: int) -> DataFrame:
    """docs without the rows whose keys are in gone: by a broadcast of up to broadcast_rows keys, by a shuffle beyond."""
    gone = written(gone.select(*keys), "gone")
    few = gone.limit(broadcast_rows + 1).count() <= broadcast_rows
    return docs.join(F.broadcast(gone) if few else gone, keys, "left_anti").select(*own_columns(docs))


def looked_up(left: DataFrame, key: str, pointers: DataFrame, how: str = "inner", hot: int = 200, often: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """left with the columns of pointers (unique, named `key` too): keys that left has over `often` times, the `hot` most
    frequent of them, meet their rows by a broadcast of at most `hot` rows, so that no task gets all rows of one key.
    counts: how often left has each key (key, count), if that is known."""
    counts = left.groupBy(key).count() if counts is None else counts
    many = counts.where(F.col("count") > often).orderBy(F.desc("count"), key).limit(hot).collect()  # at most `hot` rows
    keys = [r[key] for r in many if r[key] is not None]
    if not keys:
        return left.join(pointers, key, how)
    many = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return left.where(~many).join(pointers, key, how).unionByName(left.where(many).join(F.broadcast(pointers.where(F.col(key).isin(keys))), key, how))


def shares(left: DataFrame, key: str, often: int) -> DataFrame:
    """Of each key that left has over `often` times: the number of shares (key, shares) of about that many rows."""
    return left.groupBy(key).count().where(F.col("count") > often).select(key, F.ceil(F.col("count") / often).cast("int").alias("shares"))


def dealt_join(left: DataFrame, key: str, other: str, wide: DataFrame, parts: DataFrame) -> DataFrame:
    """left joined with wide (unique by key, rows too wide to broadcast): the rows of a key in parts (see shares; a written
    table) are dealt by another column into its shares, each of which meets a copy of the key's row of wide. A task so gets
    about as many rows of a key as a share has, and wide is copied once a share, not once a row."""
    if not parts.limit(1).count():
        return left.join(wide, key)
    n = F.coalesce("shares", F.lit(1))
    dealt = looked_up(left, key, parts, "left").withColumn("share", F.pmod(F.xxhash64(other), n).cast("int")).drop("shares")
    copies = wide.join(parts, key, "left").withColumn("share", F.explode(F.sequence(F.lit(0), n - 1))).drop("shares")
    return dealt.join(copies, [key, "share"]).drop("share")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), as (node, component) with the smallest node of each component.

    Every round hooks each node onto its smallest neighbour, jumps pointers until all nodes point at roots, and contracts the
    edges to those between roots. A root that two rounds leave with an edge has taken in a node of its own, so at least half
    of the roots go in two rounds, whatever the order of the nodes; rounds go on until no edge is left. Minima combine on the
    map side and hot labels are looked up by broadcast, so a large component makes no large task. Null ends are dropped.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while both.limit(1).count():
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "labels")
        moved = 1
        while moved:
            next_up = up.select(F.col("node").alias("up"), F.col("up").alias("k"))
            new = written(looked_up(up, "up", next_up).select("node", F.col("k").alias("up"), (F.col("k") != F.col("up")).alias("moved")), "labels")
            moved = new.where("moved").limit(1).count()
            up = new.select("node", "up")
        rounds.append(up)
        for c in ("a", "b"):
            both = looked_up(both, c, up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")))
        both = written(both.where("a_up <> b_up").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct(), "edges")
    if not rounds:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds.pop()
    for up in reversed(rounds):
        labels = looked_up(up, "up", labels.select(F.col("node").alias("up"), F.col("up").alias("k")), "left").select("node", F.coalesce("k", "up").alias("up"))
    return written(labels.select("node", F.col("up").alias("component")), "labels")


def scanned(rows: RDD, group: Callable[[Any], Any], element: Callable[[Any], Any], join: Callable[[Any, Any], Any], zero: Any) -> RDD:
    """Running totals over rows that are sorted over all partitions: (row, the total before it, the total with it), where each
    group (consecutive rows) starts from zero. join must be associative. One record a partition, its first and last group with
    the total of the last one, tells the driver where each partition goes on, so a group of any size may lie over many."""

    def ends(p: int, held: Iterator[Any]) -> Iterator[tuple]:
        first = last = total = None
        n = 0
        for row in held:
            g = group(row)
            if not n or g != last:
                first, last, total, n = (g, g, zero, 1) if not n else (first, g, zero, n + 1)
            total = join(total, element(row))
        if n:
            yield p, first, last, total, n

    start: dict[int, Any] = {}
    running, so_far = None, zero
    for p, first, last, total, n in sorted(rows.mapPartitionsWithIndex(ends).collect(), key=lambda x: x[0]):  # a record a partition
        start[p] = so_far if running is not None and running[0] == first else zero
        running, so_far = (last,), join(start[p], total) if n == 1 else total

    def run(p: int, held: Iterator[Any]) -> Iterator[tuple]:
        total, last, fresh = start.get(p, zero), None, True
        for row in held:
            g = group(row)
            if not fresh and g != last:
                total = zero
            last, fresh, before = g, False, total
            total = join(total, element(row))
            yield row, before, total

    return rows.mapPartitionsWithIndex(run)
