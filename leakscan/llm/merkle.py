"""A Merkle manifest of a dataset: a tree for each source over its rows by id, and a tree over the sources' roots.

H is the lowercase hex SHA-256 of its inputs' concatenation, digests as hex text. A leaf is H of the row's fields; while a source
has several nodes, every `fan` consecutive ones (the last run may be shorter, even one) become their H; what remains is the
source's subroot. The subroots, ordered by source, give the root in the same way. A proof lists, level by level from the leaf to
the root, the digests left and right of the node on the way.

A tree needs its nodes in order and their places. Leaves are range-sorted into an RDD, so that a source of any size lies over as
many partitions as it fills. One small record a partition (its first and last source, with counts) tells the driver where each
partition's first source goes on and how long the sources at its ends are; sources inside a partition are whole. Then every
partition builds all complete aligned subtrees of its own leaves. Only the ragged nodes, whose runs reach into other partitions (at
most 2 * fan a level at either end of a partition), are shuffled, by the coordinate of the block of tree that they lie in; each
round of blocks finishes some levels more, until every source has its root. On the way back each block hands its path to its
nodes, and the nodes' paths go to the partition that the nodes came from, where the leaves' own paths are put before them. Leaves
are shuffled once, without their texts.

Nulls: a null field is `-`; a null source or id is a value of its own that comes first; a row with a null id is never tampered
with. Empty texts are values of 0 bytes. Rows with equal ids follow each other by leaf, so repeated rows get the same digests
whatever their order. An empty table gives no rows. Further columns are ignored. The table of leaves lies in the shared folder
until the result has been read; everything above is lineage, which a lost executor's successor repeats.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from typing import Any

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Path = list[tuple[str, str]]  # for each level what stands left and right of the node, joined


@dataclass(frozen=True)
class TreeRules:
    """fan: nodes of a full run; per_task: leaves of a partition, about; levels: how many levels a round of blocks finishes."""

    fan: int = 3
    per_task: int = 20_000
    levels: int = 5


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """H of fields, each `-` if null, else its UTF-8 byte count, a colon and its value."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def width(n: int, level: int, fan: int) -> int:
    """How many nodes a tree over n leaves has at a level."""
    return -(-n // fan**level)


def height(n: int, fan: int) -> int:
    h = 0
    while width(n, h, fan) > 1:
        h += 1
    return h


def grow(nodes: Iterable[tuple[int, int, str]], n: int, fan: int, most: int) -> list[dict[int, str]]:
    """By level up to `most`: the given nodes (level, index, digest) of a tree over n leaves, and all that follow from them."""
    levels: list[dict[int, str]] = [{} for _ in range(most + 1)]
    for level, i, d in nodes:
        levels[level][i] = d
    for level in range(most):
        held, wide = levels[level], width(n, level, fan)
        for up in {i // fan for i in held}:
            run = [held.get(i) for i in range(up * fan, min(up * fan + fan, wide))]
            if None not in run:
                levels[level + 1][up] = digest("".join(run))
    return levels


def climb(levels: list[dict[int, str]], n: int, fan: int, level: int, i: int) -> tuple[Path, int, int]:
    """The path from a node up to the highest node above it in levels, and that node's level and index."""
    path = []
    while level + 1 < len(levels) and (up := i // fan) in levels[level + 1]:
        held = levels[level]
        path.append(("".join([held[j] for j in range(up * fan, i)]), "".join([held[j] for j in range(i + 1, min(up * fan + fan, width(n, level, fan)))])))
        level, i = level + 1, up
    return path, level, i


def tops(levels: list[dict[int, str]], fan: int) -> Iterator[tuple[int, int, str]]:
    """The nodes that have no parent in levels."""
    for level, held in enumerate(levels):
        above = levels[level + 1] if level + 1 < len(levels) else {}
        yield from ((level, i, d) for i, d in held.items() if i // fan not in above)


class Forest:
    """Trees over items (group, key, digest, row), each group's in the order of its keys. Groups and keys are tuples to sort by.

    The partitions of `parts` hold the sorted items. Of the groups at a partition's ends the driver keeps places and lengths,
    a few numbers for each partition."""

    def __init__(self, items: RDD, count: int, parts: int, rules: TreeRules) -> None:
        self.rules = rules
        # at most 20 keys a partition and 10^6 in all; they balance the partitions and change no result
        share = min(1.0, min(20 * parts, 1_000_000) / max(count, 1))
        keys = sorted(items.map(lambda x: x[:2]).sample(False, share, 1).collect()) if parts > 1 else []
        bounds = [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []
        dealt = items.map(lambda x: (bisect_left(bounds, x[:2]), x)).partitionBy(parts, int)
        self.parts = dealt.mapPartitions(lambda rows: iter(sorted((x for _, x in rows), key=lambda x: x[:2])), preservesPartitioning=True)

        def ends(p: int, rows: Iterator[tuple]) -> Iterator[tuple]:
            runs = [(group, sum(1 for _ in same)) for group, same in groupby(rows, key=lambda x: x[0])]
            if runs:
                yield p, runs[0], runs[-1], len(runs), max(n for _, n in runs)

        stats = sorted(self.parts.mapPartitionsWithIndex(ends).collect())  # a record a partition
        total: dict[Any, int] = {}
        start: dict[int, int] = {}
        for p, (first, n), (last, m), several, _ in stats:
            start[p] = total.get(first, 0)
            total[first] = start[p] + n
            if several > 1:
                total[last] = m
        self.places = {p: (start[p], total[first], total[last]) for p, (first, _), (last, _), *_ in stats}
        self.longest = max([*total.values(), *(s[4] for s in stats)], default=0)

    def trees(self) -> Callable[[int, Iterator[tuple]], Iterator[tuple[Any, int, int, list[tuple], list[dict[int, str]]]]]:
        """Of a partition's items: each group, its length, the place of its first item here, its items here and their subtrees."""
        places, fan = self.places, self.rules.fan

        def build(p: int, rows: Iterator[tuple]) -> Iterator[tuple]:
            runs = [(group, list(same)) for group, same in groupby(rows, key=lambda x: x[0])]
            for k, (group, held) in enumerate(runs):
                at, of_first, of_last = places[p]
                lo, n = (at, of_first) if k == 0 else (0, of_last if k == len(runs) - 1 else len(held))
                levels = grow(((0, lo + i, x[2]) for i, x in enumerate(held)), n, fan, height(n, fan))
                yield group, n, lo, held, levels

        return build

    def ascend(self) -> RDD:
        """Finishes all trees: (group, (root, id of the node that is the root)). Keeps the rounds of blocks for descend()."""
        build, fan, step, spread = self.trees(), self.rules.fan, self.rules.levels, self.parts.getNumPartitions()

        def ragged(p: int, rows: Iterator[tuple]) -> Iterator[tuple]:
            for group, n, _, _, levels in build(p, rows):
                for level, i, d in tops(levels, fan):
                    yield group, n, level, i, d, (0, p, group, level, i)

        nodes = self.parts.mapPartitionsWithIndex(ragged)
        whole = lambda x: width(x[1], x[2], fan) == 1
        roots, self.rounds = nodes.filter(whole).map(lambda x: (x[0], (x[4], x[5]))), []
        top = height(self.longest, fan)
        # the first blocks are some levels above the partitions' own subtrees
        limit = min(top, height(max(1, self.longest // max(1, len(self.places))), fan) + step)
        nodes = nodes.filter(lambda x: not whole(x))
        while len(self.places) > 1:
            r = len(self.rounds) + 1

            def finish(x: tuple[tuple, Iterable[tuple]], limit: int = limit, r: int = r) -> tuple:
                (group, n, b), held = x[0], list(x[1])
                most = min(limit, height(n, fan))
                levels = grow((h[2:5] for h in held), n, fan, most)
                paths = [(h[5], climb(levels, n, fan, h[2], h[3])[0]) for h in held]
                return (r, group, b), (group, n, most, b, levels[most][b], (r, group, b)), paths

            low = nodes.filter(lambda x, limit=limit: x[2] < limit)
            blocks = low.map(lambda x, limit=limit: ((x[0], x[1], x[3] // fan ** (min(limit, height(x[1], fan)) - x[2])), x)).groupByKey(spread).map(finish)
            self.rounds.append(blocks)
            made = blocks.map(lambda x: x[1])
            roots = roots.union(made.filter(whole).map(lambda x: (x[0], (x[4], x[5])))).coalesce(spread)
            if limit == top:
                break
            nodes = nodes.filter(lambda x, limit=limit: x[2] >= limit).union(made.filter(lambda x: not whole(x))).coalesce(spread)
            limit = min(top, limit + step)
        return roots

    def descend(self, finished: RDD) -> RDD:
        """finished: (id of a root's node, (path above it, more)). Gives (row, digest, place, path to the top, more) for each item.

        A block's nodes are bounded, so no task gets many rows of one key on the way down."""
        spread, homes = self.parts.getNumPartitions(), finished.filter(lambda x: x[0][0] == 0)
        known = finished
        for r in range(len(self.rounds), 0, -1):
            above = known.filter(lambda x, r=r: x[0][0] == r)
            below = self.rounds[r - 1].map(lambda x: (x[0], x[2])).join(above, spread).flatMap(lambda x: [(child, (path + x[1][1][0], x[1][1][1])) for child, path in x[1][0]])
            homes = homes.union(below.filter(lambda x: x[0][0] == 0)).coalesce(spread)
            known = finished.union(below.filter(lambda x: x[0][0] > 0)).coalesce(spread)
        # to the partition that each node came from, where the sorted items are: only these few rows move
        homes = homes.map(lambda x: (x[0][1], (None, x[0][2:], x[1]))).partitionBy(spread, int)
        above = homes.mapPartitions(lambda rows: (x for _, x in rows), preservesPartitioning=True)
        build, fan = self.trees(), self.rules.fan

        def out(p: int, rows: Iterator[tuple]) -> Iterator[tuple]:
            paths, items = {}, []
            for x in rows:
                if x[0] is None:
                    paths[x[1]] = x[2]
                else:
                    items.append(x)
            for group, n, lo, held, levels in build(p, iter(items)):
                for i, x in enumerate(held, lo):
                    path, level, k = climb(levels, n, fan, 0, i)
                    upper, more = paths[group, level, k]
                    yield x[3], x[2], i, path + upper, more

        return above.union(self.parts).mapPartitionsWithIndex(out)


def proofs(docs: DataFrame, rules: TreeRules = TreeRules(), claimed_text: Column | None = None) -> tuple[RDD, Any] | None:
    """(row, leaf, place, path, (subroot, root)) of each row, where row is (doc_id, source, claimed leaf or None), and the type
    of doc_id. claimed_text: a text whose leaf is to be proven in place of the row's own; null: the own one."""
    fields = [F.col(c) for c in FIELDS]
    claimed = F.lit(None).cast("string") if claimed_text is None else F.when(claimed_text.isNotNull(), leaf(*fields[:-1], claimed_text))
    leaves = written(docs.select("doc_id", "source", leaf(*fields).alias("leaf"), claimed.alias("claimed"), F.monotonically_increasing_id().alias("tie")), "leaves")
    count = leaves.count()
    if not count:
        return None
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // rules.per_task + 1)
    first = lambda v: (v is not None, v if v is not None else 0)  # noqa: E731  nulls come first
    items = leaves.rdd.map(lambda r: (first(r[1]), (first(r[0]), r[2], r[4]), r[2], (r[0], r[1], r[3])))
    trees = Forest(items, count, parts, rules)
    subroots = trees.ascend()
    few = subroots.count()
    over = Forest(subroots.map(lambda x: ((), x[0], x[1][0], (x[1][1], x[1][0]))), few, few // rules.per_task + 1, rules)
    roots = over.ascend().map(lambda x: (x[1][1], ([], x[1][0])))
    tops_ = over.descend(roots).map(lambda x: (x[0][0], (x[3], (x[0][1], x[4]))))
    return trees.descend(tops_), docs.schema["doc_id"].dataType.simpleString()


def merkle_manifest(docs: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """One row for each row of docs: doc_id, source, place (of the leaf in its source), leaf, subroot, root, and proof, an array of
    (left, right), the digests on either side joined, from the leaf's level to the root's."""
    schema = "doc_id {}, source string, place bigint, leaf string, subroot string, root string, proof array<struct<left: string, right: string>>"
    made = proofs(docs, rules)
    if made is None:
        return docs.sparkSession.createDataFrame([], schema.format(docs.schema["doc_id"].dataType.simpleString()))
    rows, kind = made
    return docs.sparkSession.createDataFrame(rows.map(lambda x: (x[0][0], x[0][1], x[2], x[1], *x[4], x[3])), schema.format(kind), verifySchema=False)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to, of a manifest kept as a table: equal to its root if nothing was changed."""
    return F.aggregate(proof, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def verified_digests(docs: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """The manifest with each proof as a digest, and its check against a copy of the rows in which every second document (by the
    CRC-32 of its id) has lost its line ends: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    schema = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    made = proofs(docs, rules, tampered)
    if made is None:
        return docs.sparkSession.createDataFrame([], schema.format(docs.schema["doc_id"].dataType.simpleString()))

    def fold(x: tuple) -> tuple:
        (doc_id, _, claimed), own, _, path, (subroot, root) = x
        d = claimed or own
        for left, right in path:
            d = digest(left + d + right)
        return doc_id, own, subroot, root, digest("".join([left + right for left, right in path])), d, d == root

    rows, kind = made
    return docs.sparkSession.createDataFrame(rows.map(fold), schema.format(kind), verifySchema=False)
