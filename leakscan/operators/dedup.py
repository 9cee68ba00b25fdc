"""One finding per leak: overlapping hits of a line first, then copies across commits.

Order matters: `seq` orders lines (working tree first, then commits from the newest), `rank` the hits of a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import bound, let, running, settled
from ..functions.text import slashes
from .detect import with_hits
from .score import base_points

Points = Callable[[Column], Column]
ROW = ["detector_type", "matched_string", "file_path", "line_number", "commit_hash", "line_content", "entropy_score", "start_col", "end_col", "seq", "rank"]


def same_text(a: Column, b: Column) -> Column:
    spans = a["start_col"].isNotNull() & a["end_col"].isNotNull() & b["start_col"].isNotNull() & b["end_col"].isNotNull()
    return F.when(spans, (a["start_col"] < b["end_col"]) & (b["start_col"] < a["end_col"])).otherwise(a["matched_string"] == b["matched_string"])


def clusters(hits: Column, item: str) -> Column:
    """Greedy first fit: each hit joins the first cluster with an overlapping member, else starts one; clusters never merge."""
    start = F.array().cast(f"array<array<{item}>>")

    def step(found: Column, hit: Column) -> Column:
        at = F.array_position(F.transform(found, lambda c: F.exists(c, lambda m: same_text(hit, m))), True)
        # a one-element array binds the place once
        grown = lambda n: F.transform(found, lambda c, i: F.when(i + 1 == n, F.concat(c, F.array(hit))).otherwise(c))
        return F.flatten(F.transform(F.array(at), lambda n: F.when(n > 0, grown(n)).otherwise(F.concat(found, F.array(F.array(hit))))))

    return F.aggregate(hits, start, step)


FEW = 8  # hits that are simply compared with each other


def span_clusters(hits: Column, item: str) -> Column:
    """clusters() of hits that all have spans, in about linear time.

    A sweep by starts with the furthest end so far cuts the hits where nothing overlaps: no cluster reaches over such a cut, so
    each part is clustered alone. A part whose first hit (in their order) overlaps all the others is one cluster, since each of
    them joins the first one there is; of one or two hits this is always so. Only other parts are searched hit by hit."""
    placed = F.transform(hits, lambda h, i: F.struct(h["start_col"].alias("a"), i.alias("i"), h.alias("h")))
    fresh = lambda far, x: x["a"] >= far

    def parts(ordered: Column) -> Column:
        cuts = running(ordered, F.lit(0), lambda far, x: F.greatest(far, x["h"]["end_col"]), fresh, "boolean")
        starts = F.filter(F.transform(cuts, lambda c, i: F.when(c | (i == 0), i + 1)), lambda i: i.isNotNull())
        # a part goes on to the next one's start
        return let(starts, lambda at: F.zip_with(at, F.concat(F.slice(at, 2, 1 << 30), F.array(F.size(ordered) + 1)), lambda x, y: F.slice(ordered, x, y - x)))

    def split(part: Column) -> Column:
        own = F.transform(F.sort_array(F.transform(part, lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h")))), lambda x: x["h"])
        return let(own, lambda hs: F.when(F.forall(hs, lambda h: same_text(hs[0], h)), F.array(hs)).otherwise(clusters(hs, item)))

    swept = let(F.sort_array(placed), lambda ordered: F.flatten(F.transform(parts(ordered), split)))
    # a second hit joins the first one or not
    pair = F.when(same_text(hits[1], hits[0]), F.array(hits)).otherwise(F.array(F.array(hits[0]), F.array(hits[1])))
    return F.when(F.size(hits) == 2, pair).when(F.size(hits) <= FEW, clusters(hits, item)).otherwise(swept)


def representatives(found: DataFrame, points: Points = base_points) -> DataFrame:
    """One row for each cluster (column c): the member with the most base points, then the longest match, then the earliest;
    it takes the first entropy score of the cluster if it has none."""
    key = lambda m: F.struct(points(m["detector_type"]).alias("p"), F.length(m["matched_string"]).alias("n"), (-m["seq"]).alias("s"), (-m["rank"]).alias("r"), m.alias("m"))
    scores = F.filter(F.transform("c", lambda m: m["entropy_score"]), lambda e: e.isNotNull())
    picked = settled(found).select(F.array_max(F.transform("c", key)).alias("t"), F.get(scores, F.lit(0)).alias("score"))
    return settled(picked).select(*[F.coalesce(F.col("t.m.entropy_score"), "score").alias(c) if c == "entropy_score" else F.col(f"t.m.{c}").alias(c) for c in ROW])


def collapse_lines(raw: DataFrame, points: Points = base_points) -> DataFrame:
    """First pass, for any findings: hits on one line (path, commit, number) that point at the same text become one."""
    raw = raw.select(*ROW)
    item = raw.select(F.struct(*ROW).alias("x")).schema["x"].dataType.simpleString()
    order = F.struct("seq", "rank", F.struct(*ROW).alias("x"))
    grouped = raw.groupBy(slashes(F.col("file_path")).alias("np"), "commit_hash", "line_number").agg(F.sort_array(F.collect_list(order)).alias("h"))
    placed = lambda hs: F.when(F.forall(hs, lambda h: h["start_col"].isNotNull() & h["end_col"].isNotNull()), span_clusters(hs, item)).otherwise(clusters(hs, item))
    found = settled(grouped.select(let(F.transform("h", lambda h: h["x"]), placed).alias("cs")))
    return representatives(found.select(F.explode("cs").alias("c")), points)


def hit_order(points: Points = base_points) -> Column:
    """What represents a path's secret is its largest hit in this order: the best one in the working tree, else the oldest."""
    choice = lambda on, p, n, s, r: F.struct(F.lit(on).alias("a"), p.alias("b"), n.alias("l"), s.alias("s"), r.alias("r"))
    live = choice(1, points(F.col("detector_type")), F.length("matched_string"), -F.col("seq"), -F.col("rank"))
    return F.when(F.col("commit_hash").isNull(), live).otherwise(choice(0, F.lit(0), F.lit(0), F.col("seq"), F.col("rank").cast("int")))


def collapse_commits(found: DataFrame, points: Points = base_points) -> DataFrame:
    """Second pass: one row per path and secret, with occurrences and history_commits (oldest first), and seq and rank of the
    first hit. A copy in the working tree represents the rest, else the oldest commit's."""
    order = hit_order(points)
    row = F.struct(*[c for c in ROW if c not in ("seq", "rank") and c in found.columns])
    first = F.struct("seq", "rank")
    scored = F.when(F.col("entropy_score").isNotNull(), F.struct("seq", "rank", "entropy_score"))
    # by commit first, so that no more than its distinct commits meet in the row of a secret
    # rows are sorted for this: a hash in front settles nearly all comparisons at once. Each choice and what it brings is one value
    each = found.withColumn("np", slashes(F.col("file_path"))).withColumn("spot", F.xxhash64("np", "matched_string")).groupBy("spot", "np", "matched_string", "commit_hash").agg(
        F.max(F.struct(order.alias("rated"), row.alias("row"))).alias("top"), F.min(scored).alias("scored"),
        F.count(F.lit(1)).alias("n"), F.max(first).alias("last"), F.min(first).alias("first"),
    )
    commit = F.when(F.coalesce("commit_hash", F.lit("")) != "", F.struct("last.seq", "last.rank", "commit_hash"))
    grouped = each.groupBy("spot", "np", "matched_string").agg(
        F.max("top").alias("top"), F.min("scored").alias("scored"), F.sum("n").cast("int").alias("occurrences"),
        F.sort_array(F.collect_list(commit), asc=False).alias("commits"), F.min("first").alias("first"),
    )
    return grouped.select(
        *[F.coalesce("top.row.entropy_score", "scored.entropy_score").alias(c) if c == "entropy_score" else F.col(f"top.row.{c}").alias(c) for c in ROW if c not in ("seq", "rank") and c in found.columns],
        "occurrences", F.transform("commits", lambda c: c["commit_hash"]).alias("history_commits"), "first.seq", "first.rank",
    )


def deduplicate(raw: DataFrame, points: Points = base_points) -> DataFrame:
    """points: base points of a column of types, for callers with a scale of their own."""
    return collapse_commits(collapse_lines(raw, points), points)


def line_findings(lines: DataFrame, **options) -> DataFrame:
    """The first pass for scans, where each line of a path and commit is one row: hits are clustered inside their row, without
    a shuffle. The result is that of collapse_lines over raw_findings. Hits do not carry their line while they are clustered."""
    hits = with_hits(lines, **options)
    of = {"detector_type": "type", "matched_string": "matched_string", "entropy_score": "entropy_score", "start_col": "start_col", "end_col": "end_col"}
    own = ["file_path", "line_number", "commit_hash", "line_content", "seq"]
    rows = hits.where(F.size("hits") > 0).select(*own, F.transform("hits", lambda h, i: F.struct(*[h[x].alias(c) for c, x in of.items()], i.alias("rank"))).alias("h"))
    item = rows.schema["h"].dataType.elementType.simpleString()
    key = lambda m: F.struct(base_points(m["detector_type"]).alias("p"), F.length(m["matched_string"]).alias("n"), (-m["rank"]).alias("r"), m.alias("m"))

    def best(c: Column) -> Column:
        scores = F.filter(F.transform(c, lambda m: m["entropy_score"]), lambda e: e.isNotNull())
        return F.struct(F.array_max(F.transform(c, key))["m"].alias("m"), F.get(scores, F.lit(0)).alias("score"))

    # most lines hold one hit
    alone = F.array(F.struct(F.col("h")[0].alias("m"), F.col("h")[0]["entropy_score"].alias("score")))
    found = bound(rows, b=F.when(F.size("h") == 1, alone).otherwise(F.transform(span_clusters(F.col("h"), item), best)))
    found = found.select(*own, F.explode("b").alias("t"))
    return found.select(*[F.coalesce(F.col("t.m.entropy_score"), "t.score").alias(c) if c == "entropy_score" else F.col(c) if c in own else F.col(f"t.m.{c}").alias(c) for c in ROW])
