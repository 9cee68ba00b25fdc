"""Keeping costly expressions from being evaluated again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with columns that later filters and columns refer to instead of repeating their expressions: the
    optimizer moves filters below projections, but not below a generator."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row")).select("row.*")


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, settled(); the others stay beside the generator, so that what nobody reads is pruned."""
    kept = [c for c in df.columns if c not in columns]
    # made by a projection, which is compiled; a generator of expressions with lambdas is not
    return df.withColumns(columns).select(*kept, F.explode(F.array(F.struct(*columns))).alias("bound row")).select(*kept, "bound row.*")


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """The session's checkpoint folder, which all executors see, or a fresh folder in it. A local session that names none gets
    one of this machine; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leakscan-")  # as in tests
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}" if name else folder


def once(df: DataFrame) -> DataFrame:
    """The same rows, computed once for all uses and kept in the shared checkpoint folder, so that lost executors lose nothing."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has no more rows than that; computed for the count, so better from a table or checkpoint."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows ahead of costly expressions: dealt out evenly over the cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once: a one-element array binds it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


CHUNK = 128


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state before, item) of each item of an array, as an array of `kind`, where step(state, item) gives the next state.
    An array that grows by one is copied at each step, so outputs are gathered in chunks, and the chunks in the end."""
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, x: Column) -> Column:
        return F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(emit(s["state"], x))).alias("out"))

    def chunk(s: Column, part: Column) -> Column:
        return let(F.aggregate(part, F.struct(s["state"].alias("state"), none.alias("out")), one), lambda r: F.struct(r["state"].alias("state"), F.concat(s["out"], F.array(r["out"])).alias("out")))

    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))
    return F.aggregate(chunks, F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), chunk, lambda s: F.flatten(s["out"]))
