"""Benchmark decontamination: CGK embedding, bit-sampling LSH, and exact edit distances over word windows.

A document is contaminated by an item when some run of its words is within floor(max_edits * words) word edits of the item.
Words are lower-cased runs of letters and digits, so changes of case and punctuation cost nothing.

The CGK walk reads a word sequence with random bits: step j writes the current word and moves on if bit j of that word says so.
Sequences at a small edit distance then write outputs at a small Hamming distance, and tables keyed by a few sampled steps
collide: their number follows from the target recall. Windows of an item's size class start at every word; a window is
embedded only where it holds as many of the items' word 3-grams as any passage within the edit distance must (the q-gram
lemma; 2-grams or words where an item is too short for its edits), which loses nothing. A collision is verified by the exact edit distance between the item and the words around it.

Items are a small table: their index is built on the driver in blocks of about `item_block` items and `item_bytes` bytes at most,
each sent to the executors; more items mean more passes, and there is no shuffle. Items of one or two words allow no edit and
are looked up word by word. Null and empty items and texts match nothing. Repeated rows and ids give repeated results. Of several
closest places the first is reported. Further columns are ignored, and drop_leaks keeps them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, slices

WORD = re.compile(r"[^\W_]+")
Q = 3
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakRules:
    """max_edits: edits per item word; recall: target of the LSH; far: largest share of differing steps it is aimed at; sampled:
    steps in a table's key; walks: independent embeddings; item_block, item_bytes: see the module."""

    max_edits: float = 0.2
    recall: float = 0.95
    far: float = 0.6
    sampled: int = 3
    walks: int = 6
    item_block: int = 20_000
    item_bytes: int = 50_000_000
    seed: int = 7

    def edits(self, words: int) -> int:
        return int(self.max_edits * words + 1e-9)

    @property
    def tables(self) -> int:
        n = math.ceil(math.log(1 - self.recall) / math.log(1 - (1 - self.far) ** self.sampled))
        return -(-n // self.walks) * self.walks


class Words:
    """Word hashes of texts, kept up to a bound."""

    def __init__(self, keep: int = 100_000) -> None:
        self.known: dict[str, int] = {}
        self.keep = keep

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = WORD.findall((text or "").lower()), self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
            return np.array([known[w] for w in words], np.uint64)


def grams(ids: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of each q words in a row."""
    h = np.zeros(max(0, len(ids) - q + 1), np.uint64)
    for k in range(q):
        h = h * MIX + ids[k : k + len(h)]
    return h * MIX


def gram_size(words: int, edits: int) -> int:
    """The longest grams, up to Q words, of which a passage within so many edits must still hold one."""
    return max([q for q in range(1, Q + 1) if words - q + 1 - q * edits >= 1], default=1)


class SizeClass:
    """Items of about one length, their embeddings' tables, and how windows of that class are embedded."""

    def __init__(self, items: list[int], ids: list[np.ndarray], rules: LeakRules, n: int) -> None:
        self.items = items
        sizes = [len(ids[i]) for i in items]
        self.least, self.most = min(sizes), max(sizes)
        self.reach = self.most + max(rules.edits(s) for s in sizes)
        self.q = gram_size(sizes[0], rules.edits(sizes[0]))  # that of all its items
        self.need = max(1, min(s - self.q + 1 - self.q * rules.edits(s) for s in sizes))
        self.steps = max(Q, int(1.6 * self.least))  # walks of this many steps stay inside the shortest item, mostly
        random = np.random.default_rng([rules.seed, n])
        self.bits = random.integers(1, 1 << 63, (rules.walks, self.steps), np.int64).astype(np.uint64) | np.uint64(1)
        self.at = random.integers(0, self.steps, (rules.tables, rules.sampled))
        starts = np.zeros(len(items), np.int64)
        padded = np.zeros((len(items), self.most), np.uint64)
        for k, i in enumerate(items):
            padded[k, : len(ids[i])] = ids[i]
        keys = self.keys(padded.ravel(), starts + np.arange(len(items)) * self.most, np.arange(1, len(items) + 1) * self.most)
        order = np.argsort(keys.T.ravel(), kind="stable")
        self.sorted, self.owner = keys.T.ravel()[order], np.tile(np.arange(len(items)), rules.tables)[order]

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray | int) -> np.ndarray:
        """Table keys (row, table) of the windows at starts; beyond ends the walk reads zeros."""
        walks, tables = len(self.bits), len(self.at)
        words = np.append(words, np.uint64(0))
        out = np.empty((len(starts), tables), np.uint64)
        for r in range(walks):
            trace = np.empty((self.steps, len(starts)), np.uint64)
            pos = starts.copy()
            for j in range(self.steps):
                w = words[np.where(pos < ends, pos, len(words) - 1)]
                trace[j] = w
                pos += ((w * self.bits[r, j]) >> np.uint64(63)).astype(np.int64)
            for t in range(r, tables, walks):
                h = np.full(len(starts), np.uint64(t + 1))
                for j in self.at[t]:
                    h = (h ^ trace[j]) * MIX
                    h ^= h >> np.uint64(29)
                out[:, t] = h
        return out

    def candidates(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """(item, start) pairs that collide in some table."""
        keys = self.keys(words, starts, len(words))
        lo, hi = np.searchsorted(self.sorted, keys, "left"), np.searchsorted(self.sorted, keys, "right")
        rows, cols = np.nonzero(hi > lo)
        return sorted({(self.items[self.owner[k]], int(starts[r])) for r, c in zip(rows.tolist(), cols.tolist(), strict=True) for k in range(lo[r, c], hi[r, c])})


class GramFilter:
    """Places of a text where the classes that share a gram size may have passages."""

    def __init__(self, q: int, classes: list[tuple[int, SizeClass]], ids: list[np.ndarray]) -> None:
        self.q, self.classes = q, classes
        of = [(grams(ids[k], q), n) for n, c in classes for k in c.items]
        self.grams, which = np.unique(np.concatenate([g for g, _ in of]), return_inverse=True)
        # the size classes (their numbers modulo 64, as bits) whose items hold a gram
        self.holders = np.zeros(len(self.grams), np.uint64)
        np.bitwise_or.at(self.holders, which, np.concatenate([np.full(len(g), np.uint64(1) << np.uint64(n % 64)) for g, n in of]))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        self.least = min(c.need for _, c in classes)

    def starts(self, ids: np.ndarray) -> Iterator[tuple[SizeClass, np.ndarray]]:
        """Each class with the starts of the windows that hold as many of its grams as a passage must."""
        if len(ids) < self.q:
            return
        g = grams(ids, self.q)
        maybe = np.flatnonzero(self.seen[(g >> np.uint64(42)).astype(np.int64)])
        if len(maybe) < self.least:
            return
        place = np.minimum(np.searchsorted(self.grams, g[maybe]), len(self.grams) - 1)
        real = self.grams[place] == g[maybe]
        at, holders = maybe[real], self.holders[place[real]]
        for n, c in self.classes:
            own = at[(holders >> np.uint64(n % 64)) & np.uint64(1) == 1]
            k = c.need - 1
            # need hits that one window can hold: its start may lie from the last hit less the reach to the first hit
            first = np.flatnonzero(own[k:] - own[: len(own) - k] <= c.reach - self.q) if len(own) > k else ()
            if not len(first):
                continue
            lo, hi = np.maximum(own[first + k] + self.q - c.reach, 0), own[first]
            edge = np.zeros(len(ids) + 2, np.int32)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi + 1, -1)
            yield c, np.flatnonzero(np.cumsum(edge)[: len(ids)] > 0)


class ItemIndex:
    def __init__(self, item_ids: list, texts: list[str | None], rules: LeakRules = LeakRules()) -> None:
        words = Words()
        self.rules = rules
        pairs = [(i, x) for i, x in ((i, words(t)) for i, t in zip(item_ids, texts, strict=True)) if len(x)]
        self.item_ids, self.ids = [p[0] for p in pairs], [p[1] for p in pairs]
        self.lists = [x.tolist() for x in self.ids]
        self.brief: dict[tuple[int, ...], list[int]] = {}
        for k, x in enumerate(self.lists):
            if len(x) < Q:
                self.brief.setdefault(tuple(x), []).append(k)
        self.brief_first = np.array(sorted({x[0] for x in self.brief}), np.uint64)
        size = lambda k: len(self.ids[k])
        q = lambda k: gram_size(size(k), rules.edits(size(k)))
        order = sorted((k for k in range(len(pairs)) if size(k) >= Q), key=lambda k: (q(k), size(k)))
        self.classes: list[SizeClass] = []
        while order:
            top = max(size(order[0]) + 1, int(size(order[0]) * 1.15))
            some = [k for k in order if q(k) == q(order[0]) and size(k) <= top]
            self.classes.append(SizeClass(some, self.ids, rules, len(self.classes)))
            order = order[len(some) :]
        numbered = list(enumerate(self.classes))
        self.filters = [GramFilter(n, [(i, c) for i, c in numbered if c.q == n], self.ids) for n in sorted({c.q for c in self.classes})]

    def search(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, edits, first word, words) of the closest passage for each item that a text holds."""
        return self.search_brief(ids) + self.search_long(ids)

    def search_brief(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The first places of items of under Q words."""
        found: dict[int, tuple[int, int, int, int]] = {}
        for at in np.flatnonzero(np.isin(ids, self.brief_first)).tolist() if self.brief else ():
            for n in range(1, min(Q, len(ids) - at + 1)):
                for k in self.brief.get(tuple(ids[at : at + n].tolist()), ()):
                    found.setdefault(k, (k, 0, at, n))
        return [found[k] for k in sorted(found)]

    def search_long(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The closest passages of items of Q words and more."""
        found: dict[int, list[int]] = {}
        for held in self.filters:
            for c, starts in held.starts(ids):
                for i, s in c.candidates(ids, starts):
                    found.setdefault(i, []).append(s)
        if not found:
            return []
        words, out = ids.tolist(), []
        for i, starts in sorted(found.items()):
            item, best = self.lists[i], None
            d = self.rules.edits(len(item))
            for lo, hi in spans(starts, len(item) + d):
                lo = max(0, lo - d)
                edits, a, b = nearest(item, words[lo : hi + len(item) + 2 * d])
                if edits <= d and (best is None or edits < best[1]):
                    best = (i, edits, lo + a, b - a)
            if best:
                out.append(best)
        return out


def spans(starts: list[int], gap: int) -> list[tuple[int, int]]:
    """Merges sorted starts that lie within gap of each other."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [(a, b) for a, b in out]


def nearest(item: list, text: list) -> tuple[int, int, int]:
    """Least edit distance between item and any run of text, with the run's start and end (the first such end)."""
    best = (len(item), 0, 0)
    column, begin = list(range(len(item) + 1)), [0] * (len(item) + 1)
    for j, w in enumerate(text, 1):
        corner, corner_begin = column[0], begin[0]
        begin[0] = j
        for i, x in enumerate(item, 1):
            cost, start = corner + (x != w), corner_begin
            if column[i] + 1 < cost:
                cost, start = column[i] + 1, begin[i]
            if column[i - 1] + 1 < cost:
                cost, start = column[i - 1] + 1, begin[i - 1]
            corner, corner_begin = column[i], begin[i]
            column[i], begin[i] = cost, start
        if column[-1] < best[0]:
            best = (column[-1], begin[-1], j)
    return best


def item_indexes(docs: DataFrame, items: DataFrame, rules: LeakRules) -> Iterator:
    """The index of each block of items, broadcast."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // rules.item_block), -(-size["bytes"] // rules.item_bytes))
    for n in range(blocks):
        some = items.select("item_id", "text")
        # a block holds about item_block items, whatever their number
        rows = (some if blocks == 1 else some.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"] or ""))
        yield docs.sparkSession.sparkContext.broadcast(ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], rules))


def find_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """doc_id, item_id, edits, first_word, n_words: one row for each row of docs (doc_id, text) and item (item_id, text) it
    holds a passage of, at the closest place."""
    ids = {"doc_id": docs.schema["doc_id"].dataType, "item_id": items.schema["item_id"].dataType}
    ddl = ", ".join(f"{n} {t.simpleString()}" for n, t in ids.items()) + ", edits int, first_word bigint, n_words bigint"
    types = [to_arrow_type(t) for t in ids.values()] + [pa.int32(), pa.int64(), pa.int64()]

    def searched(index) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, words = index.value, Words()
            for b in batches:
                out = [(d.as_py(), held.item_ids[i], *rest) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, *rest in held.search(words(t.as_py()))]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "edits", "first_word", "n_words"])

        return docs.select("doc_id", "text").mapInArrow(search, ddl)

    return reduce(DataFrame.unionByName, map(searched, item_indexes(docs, items, rules)))


def drop_leaks(docs: DataFrame, items: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """docs without the rows that hold a passage of an item."""

    def kept(held_docs: DataFrame, index) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, words = index.value, Words()
            for b in batches:
                for some in slices(b):
                    yield some.filter(pa.array([not held.search(words(t.as_py())) for t in some["text"]], pa.bool_()))

        return held_docs.mapInArrow(lean(keep), docs.schema)

    return reduce(kept, item_indexes(docs, items, rules), docs)
