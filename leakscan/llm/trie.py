"""The trie of conversation prefixes: which conversations share their first turns, and what sharing them saves.

A node is a distinct sequence of first turns. Nodes are numbered in preorder, so that a subtree is an interval of numbers that ends
at a stored place, and what a subtree holds is a difference of prefix sums over that order.

Each conversation's turns are put in order by a range sort with running totals over partitions (common.scanned), which also give
every turn the hash of all turns up to it: a polynomial hash, whose totals can be joined, of 127 bits. Lexicographic order of the
conversations needs only the turns where ways part: a node at which fewer conversations go on than came to its parent. A key lists
these turns with their depths, and a way that parts k times has other conversations of 1, 2, ... k turns beside it, so a key stays
small even where a conversation does not. Distinct conversations are range-sorted by key and numbered; the first one that holds a
node, and the node's depth, are the node's place in preorder, and the last one ends its subtree.

Conversations that occur often are one sequence with a count from the first step on. Joins on nodes or conversations that many rows
name go by common.looked_up(). The hash of a node's ids is taken over pieces in their order, as they stream by: a single SHA-256
cannot be computed in parts, but no more than a piece is held.

Nulls: a null turn comes first, null roles and texts are empty; rows with a null conv_id belong to no conversation and are left
out. Turns with equal numbers (repeated rows too) follow each other by the MD5 of role and text. An id whose turns all fall away is
a member of the root. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, scanned, tidied, written

MODULUS, BASE = (1 << 127) - 1, 0x5DEECE66D1A2B3C4D5E6F7081929394B  # a prime, and a number below it
ROOT = "root"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, what (MD5 of role and text, hex) and chars, the code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    what = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id is not null").select("conv_id", "turn", what.alias("what"), F.length(text).cast("long").alias("chars"))


def in_order(df: DataFrame, *keys: str) -> RDD:
    """The rows, range-sorted over all partitions: one shuffle, reused by every pass over the result."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).rdd


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % 6


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and the turns of the rebuilt conversations: conv_id, place (to sort by), what, chars. The first turns of a
    hundred's first conversation go to at most 199 ids, at most five to each."""
    spark = conversations.sparkSession
    plus = lambda a, b: a + b
    read = written(turns(conversations), "read")  # texts are read once, though a range sort samples its input first
    placed = scanned(in_order(read, "conv_id", "turn", "what"), lambda r: r[0], lambda r: 1, plus, 0).map(lambda x: (x[0][0], x[1], x[0][2], x[0][3]))
    own = written(spark.createDataFrame(placed, "conv_id bigint, place bigint, what string, chars bigint", verifySchema=False), "turns")
    ids = written(own.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id"), "ids")
    asked = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("from"), shared_turns(F.col("conv_id")).alias("h"))
    lent = own.where("conv_id % 100 = 0 and place < 5").withColumnRenamed("conv_id", "from").join(asked, "from").where("place < h")
    kept = own.where(F.col("place") >= shared_turns(F.col("conv_id")))
    return ids, lent.select("conv_id", "place", "what", "chars").unionByName(kept)


def paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and for each rebuilt turn its depth, its node and that node's parent."""
    ids, rows = rebuilt(conversations)

    def join(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        return a[0] + b[0], (a[1] * (BASE if b[0] == 1 else pow(BASE, b[0], MODULUS)) + b[1]) % MODULUS

    name = lambda total: f"{total[1]:x}.{total[0]}" if total[0] else ROOT
    hashed = scanned(in_order(rows, "conv_id", "place"), lambda r: r[0], lambda r: (1, (int(r[2], 16) + 1) % MODULUS), join, (0, 0))
    out = hashed.map(lambda x: (x[0][0], x[2][0], name(x[2]), name(x[1]), x[0][2], x[0][3]))
    schema = "conv_id bigint, depth bigint, node string, parent string, what string, chars bigint"
    return ids, written(ids.sparkSession.createDataFrame(out, schema, verifySchema=False), "paths")


def id_digests(ends: DataFrame, piece: int = 20_000) -> DataFrame:
    """node and ends_sha256 of ends (node, conv_id): the SHA-256 of each node's ids, ascending, with commas between. Ids meet
    in pieces of text; only a node's pieces pass through one task, one at a time."""

    def pieces(p: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        node, held, k = None, [], 0
        for r in rows:
            if held and (r[0] != node or len(held) >= piece):
                yield node, p, k, ",".join(held)
                held, k = [], k + 1
            node = r[0]
            held.append(str(r[1]))
        if held:
            yield node, p, k, ",".join(held)

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        node, h = None, None
        for r in rows:
            if r[0] != node:
                if h:
                    yield node, h.hexdigest()
                node, h = r[0], sha256()
            else:
                h.update(b",")
            h.update(r[3].encode())
        if h:
            yield node, h.hexdigest()

    spark = ends.sparkSession
    cut = spark.createDataFrame(in_order(ends.select("node", "conv_id"), "node", "conv_id").mapPartitionsWithIndex(pieces), "node string, p int, k int, ids string", verifySchema=False)
    streamed = cut.repartition("node").sortWithinPartitions("node", "p", "k").rdd.mapPartitions(digests)
    return spark.createDataFrame(streamed, "node string, ends_sha256 string", verifySchema=False)


def numbered(reps: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct conversations (reps: conv_id, depth) in lexicographic order: conv_id and rank."""
    parts = nodes.where("n_convs < parent_n").select("node")
    at = F.concat(F.lpad(F.hex(F.col("depth") - 1), 16, "0"), "what")
    keys = looked_up(rows.select("conv_id", "depth", "node", "what"), "node", parts).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(at)), "").alias("key"))
    keyed = reps.join(keys, "conv_id", "left").select("conv_id", F.concat(F.coalesce("key", F.lit("")), F.lpad(F.hex("depth"), 16, "0")).alias("key"))
    ranks = scanned(in_order(keyed, "key"), lambda r: 0, lambda r: 1, lambda a, b: a + b, 0).map(lambda x: (x[0][0], x[1]))
    return reps.sparkSession.createDataFrame(ranks, "conv_id bigint, rank bigint", verifySchema=False)


@tidied
def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256; and place and end, the node's number in preorder and that of the last node of its subtree."""
    spark = conversations.sparkSession
    ids, rows = paths(conversations)
    members, smallest = ids.agg(F.count("*"), F.min("conv_id")).first()
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("node", "depth"), "depth").alias("end"))
    ends = written(ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("end.node", F.lit(ROOT)).alias("node"), F.coalesce("end.depth", F.lit(0)).alias("depth")), "ends")
    # equal conversations become one, the smallest of them, with a count
    reps = written(ends.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.min("depth").alias("depth")), "sequences")
    rows = written(looked_up(rows, "conv_id", reps.select("conv_id", "copies")), "rows")
    first = lambda c: F.min(c).alias(c)  # noqa: E731  equal in all rows of a node
    found = rows.groupBy("node").agg(first("conv_id"), F.sum("copies").alias("n_convs"), *map(first, ("depth", "parent", "chars")))
    top = spark.range(1 if members else 0).select(F.lit(ROOT).alias("node"), F.lit(smallest).cast("long").alias("conv_id"), F.lit(members).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("chars"))
    found = written(found.unionByName(top), "nodes")
    above = found.select(F.col("node").alias("parent"), F.col("n_convs").alias("parent_n"), F.col("conv_id").alias("parent_conv_id"))
    nodes = written(looked_up(found, "parent", above, "left"), "nodes")

    ranks = written(numbered(reps.select("conv_id", "depth"), rows, nodes), "ranks")
    spans = looked_up(rows.select("conv_id", "node"), "conv_id", ranks).groupBy("node").agg(F.min("rank").alias("start"), F.max("rank").alias("stop"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    highest = ranks.agg(F.max("rank")).first()[0]
    own_end = reps.select("node", F.lit(True).alias("is_end"))
    nodes = nodes.join(spans, "node", "left").join(children, "node", "left").join(own_end, "node", "left")
    nodes = nodes.fillna({"start": 0, "n_children": 0, "is_end": False}).withColumn("stop", F.coalesce("stop", F.lit(highest)))

    total = scanned(
        in_order(nodes, "start", "depth"), lambda r: 0,
        lambda r: (1, int(r["n_children"] == 0), (r["n_convs"] - 1) * r["chars"]), lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]), (0, 0, 0),
    )
    columns = ("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "start", "stop", "is_end")
    placed = total.map(lambda x: (*[x[0][c] for c in columns], *x[1], *x[2][1:]))
    schema = "node string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, start bigint, stop bigint, is_end boolean, place bigint, leaves bigint, saved bigint, leaves_with bigint, saved_with bigint"
    placed = written(spark.createDataFrame(placed, schema, verifySchema=False), "preorder")
    # the node that ends conversation number `stop` is the last of the subtree
    stops = placed.where("is_end").select(F.col("start").alias("stop"), F.col("place").alias("end"), F.col("leaves_with").alias("end_leaves"), F.col("saved_with").alias("end_saved"))
    out = looked_up(placed, "stop", stops).join(id_digests(ends), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("end_leaves") - F.col("leaves")).alias("n_leaves"), (F.col("end_saved") - F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"), "place", "end",
    )
