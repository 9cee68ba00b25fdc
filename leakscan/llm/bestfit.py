"""Best-fit packing of whole documents into sequences, improved by a local search of swaps.

Only a document longer than a sequence is cut, into full pieces and a rest. Full pieces are sequences of their own. The others of
a block are placed where they fit best, those of more bits first; then the search takes the emptiest sequence and gives of it to fuller
ones, by a move, an exchange one for one, two for one or one for two, each time the step that adds most to the sum of squared
fills. Every step adds to that sum, so the search ends, and a sequence that has given all it held is gone. It stops at the least
number of sequences that the tokens allow, or where no step is left.

Blocks are packed where the texts are read and hold lengths only; no text is shuffled. Sequences that stay open after a block's
search meet those of other blocks in further rounds, a block's worth to a task, until one block is left or the rounds gain no
more. Only those few small rows are shuffled.

Nulls: a null text is empty and has one token, the separator; a null id stays null. Repeated rows and ids are packed one by one.
Of equal steps the first in the order of sequences is taken. Very long texts give many full pieces, one after the other. An empty
table gives no rows. Further columns are ignored. Each round is a table in the shared folder, so a lost executor repeats tasks of
one round only.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .packing import ODD, slices


@dataclass(frozen=True)
class BinRules:
    """tokens: of a sequence; block: pieces that are packed together; open_from: free tokens from which on a sequence is packed
    again in the next round; pairs: a giving sequence with more pieces gives no two at once; words: cached words of a worker."""

    tokens: int = 4096
    block: int = 2048
    open_from: int = 48
    pairs: int = 32
    words: int = 1_500_000


class WordTokenizer:
    """The ids that the `tokenizers` library gives for a BPE file whose words end in a suffix, with its defaults, white space
    dropped and texts in lower case. Stretches between blanks are independent of each other there, so each is encoded once and
    kept. Plain ones are cut by the file's pattern and merged in tiktoken, with a zero byte for the suffix; the library itself
    encodes all others, and whole texts with odd blanks."""

    #: What makes a text odd for the fast way: odd blanks and controls, and all from U+0250 on. Of the rest, normal forms change
    #: nothing, and lower case is one character for one but for the dotted I.
    EXOTIC = re.compile("[^\t\n\r -~\xa1-\u012f\u0131-\u024f]")
    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, most: int) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        self.slow, self.most, self.known = Tokenizer.from_file(path), most, {}
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, suffix = whole["model"], whole["model"]["end_of_word_suffix"] or ""
        self.added = re.compile("|".join(re.escape(t["content"]) for t in whole.get("added_tokens") or []) or "(?!)")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {}
        for t, i in model["vocab"].items():
            ends = suffix and t.endswith(suffix) and len(t) > len(suffix)
            ranks[bytes(of[c] for c in (t.removesuffix(suffix) if ends else t)) + b"\0" * bool(ends)] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # ids are ranks if bytes come first, then bytes with the suffix, then the merges in their order
        first = [sorted(i for k, i in ranks.items() if len(k) == 1), sorted(i for k, i in ranks.items() if len(k) == 2 and k[1] == 0)]
        ranked = first == [list(range(256)), list(range(256, 512))] and all(model["vocab"].get("".join(p)) == 512 + n for n, p in enumerate(pairs))
        self.fast = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece if ranked else None

    def plain_word(self, low: str) -> bytes:
        """The ids of a plain stretch in lower case."""
        fast = self.fast
        if low.isalpha():
            return array("I", fast(low.encode() + b"\0")).tobytes()
        return b"".join([array("I", fast(p.encode() + b"\0")).tobytes() for p in self.PIECE.findall(low)])

    def odd_word(self, text: str) -> bytes:
        if self.fast is None or self.EXOTIC.search(text) or self.added.search(text):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        return self.plain_word(text.lower())

    def __call__(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        known = self.known
        if self.fast is not None and not self.EXOTIC.search(text) and not self.added.search(text):
            words, encode = text.lower().split(), self.plain_word
        elif ODD.search(text):
            return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            words, encode = text.split(), self.odd_word
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = encode(w)
        return b"".join(map(known.__getitem__, words))


@lru_cache(2)
def worker_tokenizer(path: str, most: int) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path, most)


def best_fit(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each piece, in the order given: the fullest that it fits into, else a new one."""
    out, free = np.empty(len(sizes), np.int64), []  # free: (room left, bin), sorted
    bins = 0
    for i, n in enumerate(sizes.tolist()):
        k = bisect_left(free, (n, -1))
        if k < len(free):
            left, b = free.pop(k)
        else:
            left, b, bins = room, bins, bins + 1
        out[i] = b
        if left > n:
            insort(free, (left - n, b))
    return out


class SwapSearch:
    """Local search over the bins of a block. w: sizes; at: the bin of each piece; fill: by bin; bins with `under` free tokens or
    more give. Passes over these, the emptiest first, go on while they make bins fewer."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, room: int, pairs: int = 32, under: int = 48) -> None:
        self.w, self.at, self.room, self.pairs, self.under = sizes.astype(np.int64), at.copy(), room, pairs, under
        self.fill = np.bincount(at, weights=sizes, minlength=int(at.max()) + 1 if len(at) else 0).astype(np.int64)
        self.steps = {"move": 0, "one for one": 0, "one for two": 0, "two for one": 0}
        self.sort()

    def sort(self) -> None:
        """Pieces by bin and size: self.key is sorted, self.order has the pieces."""
        key = self.at * (2 * self.room) + self.w
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def least(self, bins: np.ndarray, need: np.ndarray, beyond: np.ndarray | None = None) -> np.ndarray:
        """For each bin the place in self.order of its smallest piece of at least `need` (after place `beyond`), else -1."""
        k = np.searchsorted(self.key, bins * (2 * self.room) + np.clip(need, 0, self.room))
        if beyond is not None:
            k = np.maximum(k, beyond + 1)
        ok = k < len(self.key)
        ok[ok] = self.at[self.order[k[ok]]] == bins[ok]
        return np.where(ok, k, -1)

    def step(self, donor: int) -> bool:
        """Takes the step that adds most to the sum of squared fills by what leaves the donor, if there is any."""
        own = self.order[np.searchsorted(self.key, donor * 2 * self.room) : np.searchsorted(self.key, (donor + 1) * 2 * self.room)]
        free = self.room - self.fill
        others = np.flatnonzero((self.fill >= self.fill[donor]) & (free > 0))
        others = others[others != donor]
        if not len(others):
            return False
        best: tuple[int, str, list[int], list[int]] = (0, "", [], [])
        gain = lambda delta, b: 2 * delta * (self.fill[b] - self.fill[donor] + delta)

        def offer(kind: str, delta: np.ndarray, bins: np.ndarray, ok: np.ndarray, gives: list[int], takes: list[np.ndarray]) -> None:
            nonlocal best
            if ok.any():
                g = np.where(ok, gain(delta, bins), 0)
                i = int(g.argmax())
                if g[i] > best[0]:
                    best = (int(g[i]), kind, gives, [int(self.order[t[i]]) for t in takes])
                    best_bin[0] = int(bins[i])

        best_bin = [-1]
        seen: set[int] = set()
        room = free[others]
        for piece in own[::-1].tolist():
            a = int(self.w[piece])
            if a in seen:
                continue
            seen.add(a)
            offer("move", np.full(len(others), a), others, room >= a, [piece], [])
            k = self.least(others, a - room)
            d = a - self.w[self.order[k]]
            offer("one for one", d, others, (k >= 0) & (d > 0), [piece], [k])
        if not best[1]:
            # the pieces of the other bins, each with the smallest second one that makes room enough
            wanted = np.zeros(len(self.fill), bool)
            wanted[others] = True
            inside = np.flatnonzero(wanted[self.at[self.order]])
            bins, w1 = self.at[self.order[inside]], self.w[self.order[inside]]
            for a in sorted(seen, reverse=True):
                k = self.least(bins, a - free[bins] - w1, inside)
                d = a - w1 - self.w[self.order[k]]
                offer("one for two", d, bins, (k >= 0) & (d > 0), [int(own[np.flatnonzero(self.w[own] == a)[0]])], [inside, k])
            if len(own) <= self.pairs:
                pairs = {int(self.w[x] + self.w[y]): (x, y) for i, x in enumerate(own.tolist()) for y in own.tolist()[:i]}
                for a, gives in sorted(pairs.items(), reverse=True):
                    k = self.least(others, a - room)
                    d = a - self.w[self.order[k]]
                    offer("two for one", d, others, (k >= 0) & (d > 0), list(gives), [k])
        if not best[1]:
            return False
        _, kind, gives, takes = best
        self.steps[kind] += 1
        delta = int(self.w[gives].sum()) - int(self.w[takes].sum() if takes else 0)
        self.at[gives], self.fill[best_bin[0]], self.fill[donor] = best_bin[0], self.fill[best_bin[0]] + delta, self.fill[donor] - delta
        if takes:
            self.at[takes] = donor
        self.sort()
        return True

    def run(self) -> np.ndarray:
        fewest = -(-int(self.w.sum()) // self.room)
        used = lambda: int((self.fill > 0).sum())
        gained = True
        while gained and used() > fewest:
            before = used()
            for donor in np.argsort(self.fill, kind="stable").tolist():
                while 0 < self.fill[donor] <= self.room - self.under and self.step(donor):
                    pass
                if used() == fewest:
                    break
            gained = used() < before
        return self.at


def pack_sizes(sizes: np.ndarray, rules: BinRules) -> list[list[int]]:
    """The pieces of each sequence."""
    # best fit goes from the larger half of the sizes down by halves, in each as they come
    order = np.argsort([-int(n).bit_length() for n in sizes], kind="stable")
    start = np.empty(len(sizes), np.int64)
    start[order] = best_fit(sizes[order], rules.tokens)
    at = SwapSearch(sizes, start, rules.tokens, rules.pairs, rules.open_from).run()
    out: dict[int, list[int]] = {}
    for i, b in enumerate(at.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


COLUMNS = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class Packer:
    """Packs the pieces of a task block by block: rows of COLUMNS, and whether the sequence is open."""

    def __init__(self, rules: BinRules, round_: int, doc_type: pa.DataType) -> None:
        self.rules, self.doc_type = rules, doc_type
        self.next = (round_ << 56) + (TaskContext.get().partitionId() << 32)
        self.held: list[tuple] = []
        self.full: list[tuple] = []

    def add(self, row: tuple) -> None:
        (self.held if row[3] < self.rules.tokens else self.full).append(row)

    def flush(self) -> pa.RecordBatch:
        rows = []
        for seq in [[r] for r in self.full] + [[self.held[i] for i in s] for s in (pack_sizes(np.array([r[3] for r in self.held]), self.rules) if self.held else [])]:
            at, open_ = 0, self.rules.tokens - sum(r[3] for r in seq) >= self.rules.open_from
            for r in seq:
                rows.append((*r, self.next, at, open_))
                at += r[3]
            self.next += 1
        self.held, self.full = [], []
        cols = list(zip(*rows, strict=True))
        types = [self.doc_type, pa.int32(), *[pa.int64()] * 5, pa.bool_()]
        names = ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")], "open"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def ready(self) -> bool:
        return len(self.held) >= self.rules.block or len(self.full) >= 16 * self.rules.block


def bin_documents(docs: DataFrame, tokenizer: str, rules: BinRules = BinRules()) -> DataFrame:
    """Packs all documents, each followed by id 1: doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each
    piece. tokenizer: path of a BPE file with word ends that every executor can read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {COLUMNS}, open boolean"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = worker_tokenizer(tokenizer, rules.words), None
        for batch in batches:
            packer = packer or Packer(rules, 0, batch.schema.field("doc_id").type)
            for some in slices(batch, 64):
                for doc_id, text in zip(some["doc_id"].to_pylist(), some["text"].to_pylist(), strict=True):
                    ids = encode(text or "") + b"\1\0\0\0"
                    for piece, a in enumerate(range(0, len(ids), 4 * rules.tokens)):
                        part = ids[a : a + 4 * rules.tokens]
                        packer.add((doc_id, piece, a // 4, len(part) // 4, zlib.crc32(part)))
                    if packer.ready():
                        yield packer.flush()
        if packer and (packer.held or packer.full):
            yield packer.flush()

    def again(round_: int) -> Any:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = None
            for batch in batches:
                packer = packer or Packer(rules, round_, batch.schema.field("doc_id").type)
                for row in zip(*[batch[c].to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")], strict=True):
                    packer.add(row)
                    if packer.ready():
                        yield packer.flush()
            if packer and packer.held:
                yield packer.flush()

        return pack

    packed = written(docs.select("doc_id", "text").mapInArrow(first, schema), "bins")
    done, round_, before = [packed.where("not open")], 0, None
    open_ = packed.where("open")
    while (count := open_.count()) and (before is None or (count < 0.8 * before and before > rules.block)):
        round_, before = round_ + 1, count
        dealt = open_.repartition(-(-count // rules.block), "sequence_id").sortWithinPartitions("sequence_id", "offset")
        packed = written(dealt.mapInArrow(again(round_), schema), "bins")
        done.append(packed.where("not open"))
        open_ = packed.where("open")
    return reduce(DataFrame.unionAll, [*done, open_]).drop("open")
