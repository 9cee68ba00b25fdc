"""N-gram Jaccard join by count vectors.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Its count vector says how many of them fall into each
of `coordinates` hash groups: a point. Two sets share at most the sum of the coordinate minima of their points, and a link needs
an overlap of at least share * (a + b) / (1 + share); so a pair, or all pairs below a node of an R-tree (by its upper corner),
is ruled out when that sum is smaller. Survivors are verified on the sets of hashes; two different shingles of one pair have
equal hashes with a probability below the product of the sizes over 2^64.

Points alone would meet in one place, so they are first spread over blocks. All shingles have one order, the rare ones first
(by how many documents hold a shingle of the same hash bucket; ties by hash). A block is a shingle, and holds the sets that have
it among their first n - ceil(share * n) + 1: linked sets always have a common shingle among these, at any size. The first one
they share at places i and j leaves room for an overlap of min(a - i, b - j), which rules out most pairs of a family of copies
that differ too much: shingles that one copy alone has come first in the order and fill up its places.

Equal sets are one node. Every node is first compared with one node only, the most central leader of its blocks (the member whose
shared shingle comes earliest), for some rounds: families of near copies fall together without all their pairs. In blocks
that still hold several components, the members outside the largest one query R-trees over all members, in cells of bounded size.
So no link between components is lost, and links inside one are not needed.

Documents without words have no shingles and no links. Rows with equal ids count as one document; a row with a null id links
with nothing and has a null component. Further columns are ignored. Which of several equal leaders is compared first is decided by
the smallest id and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, components, dealt_join, lean, looked_up, shares, tidied, without, written

MIX = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class JoinRules:
    """k: words of a shingle; percent: least Jaccard similarity; coordinates: of a count vector; buckets: hash buckets that shingles
    are counted in for their order, a table of this fixed size that is broadcast (more of them only save work); page,
    query_page: members of an R-tree and queries that meet it in one cell; rounds: of comparisons with leaders before the
    R-trees; broadcast_ids: ids that may be broadcast to pick texts, beyond which the texts are joined; often: rows of one digest, node
    or block in a join that may meet in a task, beyond which the key is hot (see common.looked_up); set_pairs: pairs of one node
    that are verified beside one copy of its set."""

    k: int = 4
    percent: int = 85
    coordinates: int = 128
    buckets: int = 1 << 20
    page: int = 1024
    query_page: int = 8192
    rounds: int = 1
    broadcast_ids: int = 1_000_000
    often: int = 10_000
    set_pairs: int = 1000

    def places(self, n: int) -> int:
        """How many of the first shingles of a set of n a linked set must share one of."""
        return n - -(-n * self.percent // 100) + 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


BLANKS = np.isin(np.arange(256), [32, *range(9, 14)])
BYTES = np.where(BLANKS, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * MIX) | np.uint64(1))


def word_hashes(data: bytes, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the first byte of each word between blanks, chunk by chunk (cut at blanks)."""
    hashes, firsts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(data):
        end = min(at + chunk, len(data))
        while end < len(data) and not BLANKS[data[end]]:
            end += 1
        part = whole[at:end]
        inside = ~BLANKS[part]
        starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        if len(starts):
            lengths = np.diff(starts, append=len(part))
            place = np.arange(starts[0], len(part)) - np.repeat(starts, lengths)
            powers = np.full(int(lengths.max()), MIX | np.uint64(1), np.uint64)
            powers[0] = 1
            # blanks count nothing, so a segment may run up to the next word
            hashes.append(mix(np.add.reduceat(BYTES[part[starts[0] :]] * np.cumprod(powers)[place], starts - starts[0])))
            firsts.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(firsts)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (UTF-8)."""
    words, firsts = word_hashes(b"\n".join(t or b"" for t in texts).translate(LOWER_BYTES))
    ends = np.searchsorted(firsts, np.cumsum([len(t or b"") + 1 for t in texts]))
    rolled = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for i in range(k if len(rolled) else 0):
        rolled = mix(rolled * MIX + words[i : i + len(rolled)])
    out, start = [], 0
    for end in ends.tolist():
        n = end - start
        if n >= k:
            out.append(np.unique(rolled[start : end - k + 1]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for i in range(start, end):
                whole = mix(whole * MIX + words[i : i + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
        start = end
    return out


def text_slices(batch: pa.RecordBatch, rows: int = 500, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch with their texts as bytes, of at most so many rows and, but for single texts, bytes."""
    at, sizes = 0, np.cumsum([0] + pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist())
    while at < len(batch):
        end = max(at + 1, min(at + rows, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1))
        part = batch.slice(at, end - at)
        yield part, part["text"].cast(pa.binary()).to_pylist()
        at = end


def bucket_counts(docs: DataFrame, rules: JoinRules) -> np.ndarray:
    """How many rows of docs hold shingles of each hash bucket: summed by tasks in parts, `buckets` numbers in all."""
    parts = min(1024, rules.buckets)  # a row holds a few KB, so that a batch of rows stays small
    size = -(-rules.buckets // parts)
    schema = "part int, counts binary"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * size, np.int64)
        for b in batches:
            for _, texts in text_slices(b):
                np.add.at(total, (np.concatenate(shingle_sets(texts, rules.k)) % np.uint64(rules.buckets)).astype(np.int64), 1)
        if total.any():
            yield rows(dict(enumerate(total.astype("<u4").reshape(parts, size))))  # of one task, so under 2^32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b["part"].to_pylist(), b["counts"], strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
        yield rows(total)

    def rows(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((parts, size), np.int64)
    for r in docs.select("text").mapInArrow(lean(tally), schema).repartition("part").mapInArrow(lean(add), schema).collect():  # at most `parts` rows
        out[r["part"]] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(out.ravel()[: rules.buckets], (1 << 32) - 1).astype(np.uint32)


def first_shingles(h: np.ndarray, counts: np.ndarray, rules: JoinRules) -> np.ndarray:
    """The shingles of a sorted set that make its blocks, in order."""
    if not len(h):
        return h
    return h[np.argsort(counts[(h % np.uint64(len(counts))).astype(np.int64)], kind="stable")[: rules.places(len(h))]]


def sketches(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """doc_id, n, digest of the set, count vector, the shingles of its blocks in order."""
    held = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, rules))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, counts = np.uint64(rules.coordinates), held.value
        for b in batches:
            for part, texts in text_slices(b):
                sets = shingle_sets(texts, rules.k)
                points = [np.bincount((h % d).astype(np.int64), minlength=rules.coordinates).astype(np.int32) for h in sets]
                blocks = [first_shingles(h, counts, rules).view(np.int64) for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].cast(pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), _lists(points, pa.int32()), _lists(blocks, pa.int64())],
                    names=["doc_id", "n", "digest", "point", "blocks"],
                )

    return docs.select("doc_id", "text").mapInArrow(lean(sketch), "doc_id bigint, n bigint, digest binary, point array<int>, blocks array<bigint>")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0), kind))


def needed(total: Column, rules: JoinRules) -> Column:
    """The least overlap of a linked pair with `total` shingles together."""
    return F.ceil(F.lit(rules.percent) * total / F.lit(100 + rules.percent) - F.lit(1e-9))


def bounded(pairs: DataFrame, nodes: DataFrame, rules: JoinRules) -> DataFrame:
    """Pairs (a, b; a written table) whose points' summed coordinate minima allow a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    most = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    met = looked_up(looked_up(pairs, "a", side("a"), often=rules.often), "b", side("b"), often=rules.often, counts=pairs.groupBy("b").count())
    return met.where(most >= needed(F.col("n_a") + F.col("n_b"), rules)).select("a", "b").distinct()


def picked(docs: DataFrame, ids: DataFrame, rules: JoinRules) -> DataFrame:
    """The rows of docs with an id of the written table ids (id): by a broadcast of up to broadcast_ids, by a shuffle beyond."""
    few = ids.limit(rules.broadcast_ids + 1).count() <= rules.broadcast_ids
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, rules: JoinRules) -> DataFrame:
    """Pairs (a, b) of ids that are linked; pairs: a written table."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = picked(docs.select("doc_id", "text"), ids, rules)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b):
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), _lists([s.view(np.int64) for s in shingle_sets(texts, rules.k)], pa.int64())], names=["doc_id", "s"])

    held = written(texts.mapInArrow(lean(sets), "doc_id bigint, s array<bigint>"), "sets")
    side = lambda c: held.select(F.col("doc_id").alias(c), F.col("s").alias(f"s_{c}"))
    parts = {c: written(shares(pairs, c, rules.set_pairs), "shares") for c in ("a", "b")}
    both = dealt_join(dealt_join(pairs, "a", "b", side("a"), parts["a"]), "b", "a", side("b"), parts["b"])
    met = both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("o"), (F.size("s_a") + F.size("s_b")).alias("t"))
    return met.where(100 * F.col("o") >= rules.percent * (F.col("t") - F.col("o"))).select("a", "b").distinct()


class RTree:
    """A bulk-loaded R-tree over points: members in order of size and leading coordinates, `fan` to a leaf, leaves `fan` to a
    node; a node keeps its upper corner and its range of sizes."""

    def __init__(self, n: np.ndarray, points: np.ndarray, fan: int = 16) -> None:
        self.fan = fan
        self.order = np.lexsort((points[:, 1] if points.shape[1] > 1 else points[:, 0], points[:, 0], n))
        self.levels = [(points[self.order], n[self.order], n[self.order])]
        while len(self.levels[-1][0]) > fan:
            p, lo, hi = self.levels[-1]
            at = np.arange(0, len(p), fan)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def search(self, n: int, point: np.ndarray, percent: int) -> np.ndarray:
        """Members that the bound does not rule out for a query of n shingles."""
        found = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            p, lo, hi = (x[found] for x in self.levels[level])
            # over a node's sizes the least needed overlap is that of its smallest member
            most = np.minimum(np.minimum(p, point).sum(1), np.minimum(hi, n))
            found = found[most * (100 + percent) >= percent * (n + lo)]
            if level:
                found = (found[:, None] * self.fan + np.arange(self.fan)).ravel()
                found = found[found < len(self.levels[level - 1][0])]
        return self.order[found]


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the component of each node."""
    return members.withColumn("component", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def room(place_a: Column, n_a: Column, place_b: Column, n_b: Column, rules: JoinRules) -> Column:
    """Whether two sets with their first common shingle at these places can be linked."""
    return F.least(n_a - place_a, n_b - place_b) >= needed(n_a + n_b, rules)


def leader_pairs(named: DataFrame, sizes: DataFrame, rules: JoinRules) -> DataFrame:
    """For each node one pair (a, b) at most: with the most central leader of its blocks that has another component. sizes: of
    the blocks (block, count)."""
    first = named.groupBy("block").agg(F.min(F.struct((F.col("place") / F.col("n")).alias("at"), "node", "component", "place", "n")).alias("l"), F.max("component").alias("top"), F.min("component").alias("low")).where("low <> top").drop("low", "top")
    met = looked_up(named, "block", written(first, "leaders"), often=rules.often, counts=sizes).where((F.col("component") != F.col("l.component")) & room(F.col("place"), F.col("n"), F.col("l.place"), F.col("l.n"), rules))
    best = met.groupBy("node").agg(F.min(F.struct("l.at", "l.node")).alias("l"))
    return best.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def open_members(named: DataFrame, sizes: DataFrame, rules: JoinRules) -> DataFrame:
    """The members of the blocks that hold several components, with the block's size and its largest component."""
    each = named.groupBy("block", "component").agg(F.count(F.lit(1)).alias("held"))
    several = each.groupBy("block").agg(F.sum("held").alias("size"), F.max(F.struct("held", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    return looked_up(named, "block", written(several, "several"), often=rules.often, counts=sizes).select("block", "node", "place", "n", "component", "size", "main")


def cell_pairs(members: DataFrame, nodes: DataFrame, sizes: DataFrame, rules: JoinRules) -> DataFrame:
    """Pairs of one block and of different components that neither their places nor the bound rule out.

    Members outside a block's largest component are its queries. A block is dealt into cells of about `page` members by
    `query_page` queries; a cell holds an R-tree of its members, and its queries stream past it.
    """
    pages, lanes = F.ceil(F.col("size") / rules.page).cast("int"), F.ceil(F.col("queries") / rules.query_page).cast("int")
    asked = written(members.where("component <> main").groupBy("block").agg(F.count(F.lit(1)).alias("queries")), "asked")
    dealt = looked_up(members, "block", asked, often=rules.often, counts=sizes).join(nodes.select("node", "point"), "node").withColumns({"pages": pages, "lanes": lanes, "deal": F.xxhash64("node")})
    out = ["block", "page", "lane", "query", "node", "component", "main", "n", "place", "point"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = dealt.withColumn("page", F.pmod("deal", "pages").cast("int")).withColumn("lane", every("lanes")).withColumn("query", F.lit(0)).select(out)
    queries = dealt.where("component <> main").withColumn("lane", F.pmod("deal", "lanes").cast("int")).withColumn("page", every("pages")).withColumn("query", F.lit(1)).select(out)
    cells = held.union(queries).withColumn("cell", F.xxhash64("block", "page", "lane")).drop("page", "lane")
    ordered = cells.repartition("cell").sortWithinPartitions("cell", "block", "query", "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        now, tree, whole = None, None, {}
        for b in batches:
            col = {c: b[c].to_numpy() for c in ("cell", "block", "query", "node", "component", "main", "n", "place")}
            col["point"] = b["point"].flatten().to_numpy().reshape(len(b), -1)
            change = (col["cell"][1:] != col["cell"][:-1]) | (col["block"][1:] != col["block"][:-1]) | (col["query"][1:] != col["query"][:-1])
            ends = [*(np.flatnonzero(change) + 1).tolist(), len(b)] if len(b) else []
            start = 0
            for end in ends:
                part, key = {c: x[start:end] for c, x in col.items()}, (col["cell"][start], col["block"][start])
                if key != now:
                    now, held, tree = key, [], None
                if not part["query"][0]:
                    held.append(part)
                else:
                    if tree is None and held:
                        whole = {c: np.concatenate([x[c] for x in held]) for c in part}
                        tree, held = RTree(whole["n"], whole["point"]), []
                    if tree is not None:
                        for both in matches(part, whole, tree):
                            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
                start = end

    def matches(queries: dict[str, np.ndarray], data: dict[str, np.ndarray], tree: RTree, most: int = 1 << 16) -> Iterator[np.ndarray]:
        """Pairs, about `most` at a time: a query may meet a whole page, so all of a batch's are not held."""
        side = data["component"] != data["main"]  # these are queries too: such pairs are taken once
        out, n_out = [], 0
        for q, comp, n, place, point in zip(*(queries[c] for c in ("node", "component", "n", "place", "point")), strict=True):
            f = tree.search(int(n), point, rules.percent)
            f = f[(data["component"][f] != comp) & ~(side[f] & (data["node"][f] <= q))]
            f = f[np.minimum(n - place, data["n"][f] - data["place"][f]) * (100 + rules.percent) >= rules.percent * (n + data["n"][f])]
            out.append(np.stack([np.minimum(data["node"][f], q), np.maximum(data["node"][f], q)], 1))
            n_out += len(f)
            if n_out >= most:
                yield np.concatenate(out)
                out, n_out = [], 0
        if n_out:
            yield np.concatenate(out)

    return ordered.mapInArrow(lean(search), "a bigint, b bigint").distinct()


@tidied
def jaccard_components(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs (doc_id integer, text)."""
    rows = written(sketches(docs, rules), "sketches")
    usable = rows.where("n > 0 and doc_id is not null")
    # one node per set, named by its smallest id
    named = written(usable.groupBy("digest").agg(F.min("doc_id").alias("node")), "names")
    kept = picked(usable, named.select(F.col("node").alias("id")), rules).withColumnRenamed("doc_id", "node")
    nodes = kept.select("node", "n", "point")
    blocks = kept.select("node", F.col("n").cast("int").alias("n"), F.posexplode("blocks").alias("place", "block"))
    # of a block of two it is known at once whether its places leave room for a link
    end = lambda f: f(F.struct("node", "n", "place"))
    shared = blocks.groupBy("block").agg(end(F.min).alias("x"), end(F.max).alias("y"), F.count(F.lit(1)).alias("size")).where("x.node <> y.node")
    shared = shared.where((F.col("size") > 2) | room(F.col("x.place"), F.col("x.n"), F.col("y.place"), F.col("y.n"), rules))
    sizes = written(shared.select("block", F.col("size").alias("count")), "sizes")
    members = written(looked_up(blocks, "block", sizes.select("block"), often=rules.often, counts=sizes), "members")
    tried, links, labels = None, None, None
    for _ in range(rules.rounds):
        found = leader_pairs(labelled(members, labels), sizes, rules)
        found = written(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "led")
        found = written(bounded(found, nodes, rules), "pairs")
        new = written(verified(found, docs, rules), "links")
        tried, links = (found, new) if tried is None else (tried.union(found), links.union(new))
        labels = components(links)
    rest = cell_pairs(written(open_members(labelled(members, labels), sizes, rules), "open"), nodes, sizes, rules)
    rest = written(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    found = written(verified(rest, docs, rules), "links")
    labels = components(found if links is None else links.union(found))
    by_text = F.hex("digest").alias("digest")
    same = looked_up(usable.select(F.col("doc_id").alias("d"), by_text), "digest", named.select(by_text, "node"), often=rules.often)
    same = written(same.select("d", "node"), "same")
    alias = same.where("d <> node").union(same.where("d = node").distinct())
    known = looked_up(alias, "node", labels, "left", often=rules.often).groupBy("d").agg(F.min(F.coalesce("component", "node")).alias("component"))
    return rows.join(known, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """docs without the documents that are linked, directly or by others, to one with a smaller id."""
    gone = jaccard_components(docs, rules).where("component_id < doc_id").select("doc_id").distinct()
    return without(docs, gone, ["doc_id"], rules.broadcast_ids)
