"""Packing of examples into training sequences: vector bin packing by the dot-product heuristic.

An example has three demands: tokens, one segment, and loss-bearing tokens. A sequence has a limit for each. A sequence takes,
again and again, the example that fits and whose demand has the largest dot product with what is left of the limits (both as
shares of the limits). An example above a limit fills a fresh sequence first: capped to the limits its demand has the largest
product of all. Where examples may be cut, the room that is left is filled by a cut of the largest example that bears no more
loss for each token than the room does (else of the largest); the last free segment goes to such a cut too. A sequence that
the loss limit closes within 1/32 of its tokens is padded; what else stays short is cut at powers of two, which need no padding.

Of documents, tokens with a letter or digit bear loss; blanks, punctuation and the separator do not.

Blocks of examples are packed where they are read: there is no shuffle, a block has a bounded number of examples and, but for
one text, of bytes, and a sequence's number follows from the task's place, so that a repeated task gives the same rows.

Nulls: a null text is empty and has one token, the separator. Repeated rows and ids are packed one by one. Of equal products the
earlier example of the block (the longer one, then the first read) is taken. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, slices


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments, loss-bearing tokens. block, block_bytes: a block of examples that are packed together ends
    at so many examples or bytes of text, which bounds memory; where blocks end changes the sequences but drops nothing."""

    tokens: int = 1024
    segments: int = 8
    loss: int = 960
    block: int = 2048
    block_bytes: int = 16_000_000


#: Characters that regex engines do not agree on as blanks; texts with any take the slower way.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]")


class ByteTokenizer:
    """The ids that the `tokenizers` library gives for a byte-level BPE file, with its defaults. Where the file's ids follow its
    merges, as they do when ids are ranks, the same merges run in tiktoken, which is several times faster; else, and for texts
    with odd blanks or an added token, the library itself runs.

    bears_loss: for each id, whether its bytes hold a letter or digit (all bytes of other scripts count as letters)."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, added = whole["model"], whole.get("added_tokens") or []
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # byte-level BPE writes a byte as a printable character: itself, or one of those from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        self.bears_loss = np.zeros(1 + max([0, *vocab.values(), *(t["id"] for t in added)]), bool)
        self.bears_loss[[i for t, i in vocab.items() if any(chr(b).isalnum() or b > 127 for b in (of.get(c, 0) for c in t))]] = True
        self.bears_loss[[t["id"] for t in added]] = False
        self.fast = None
        if not whole.get("normalizer") and all(vocab.get("".join(p)) == 256 + n for n, p in enumerate(pairs)):
            ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        fast = self.fast
        return [array("I", self.slow.encode(t, add_special_tokens=False).ids if fast is None or ODD.search(t) or self.added.search(t) else fast.encode_ordinary(t)).tobytes() for t in texts]


@lru_cache(2)
def worker_tokenizer(path: str) -> ByteTokenizer:
    """One for each Python worker."""
    return ByteTokenizer(path)


def pack_block(tokens: np.ndarray, loss: np.ndarray, limits: Limits, sums: list[np.ndarray] | None = None) -> list[list[tuple[int, int, int]]]:
    """Packs a block of examples: sequences of pieces (example, start, length).

    With sums, each example's loss-bearing tokens before every place (tokens + 1 numbers), examples may be cut; without, each
    must be within the limits. Ties go to the earlier example.
    """
    cut = sums is not None
    left_t, left_l, start = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy(), np.zeros(len(tokens), np.int64)
    order = np.argsort(-left_t, kind="stable")
    left_t, left_l, open_ = left_t[order], left_l[order], np.ones(len(order), bool)
    out = []
    size = np.array([limits.tokens, limits.segments, limits.loss], float)
    demand = np.stack([left_t / size[0], np.full(len(order), 1 / size[1]), left_l / size[2]])
    todo = len(order)
    while todo:
        t, s, l = limits.tokens, limits.segments, limits.loss
        seq: list[tuple[int, int, int]] = []
        while todo and t and s:
            fits = open_ & (left_t <= t) & (left_l <= l)
            widest = int(np.where(open_, left_t, -1).argmax()) if cut else 0
            filling = cut and left_t[widest] > t and (not seq or s == 1)  # a fresh sequence, or the last segment of one
            if fits.any() and not filling:
                score = np.where(fits, np.array([t, s, l]) / size @ demand, -1.0)
                i = int(score.argmax())
                n = int(left_t[i])
                seq.append((int(order[i]), int(start[i]), n))
                open_[i], todo = False, todo - 1
                t, s, l = t - n, s - 1, l - int(left_l[i])
            elif cut:
                lean = open_ & (left_t > t) & (left_l * t <= left_t * l)
                i = int(np.where(lean, left_t, -1).argmax()) if lean.any() else widest
                before, a = sums[order[i]], int(start[i])
                n = min(t, int(left_t[i]), int(np.searchsorted(before, before[a] + l, "right")) - 1 - a)
                if n <= 0:
                    break  # no room for its next token's loss
                b = int(before[a + n] - before[a])
                seq.append((int(order[i]), a, n))
                start[i], left_t[i], left_l[i] = a + n, left_t[i] - n, left_l[i] - b
                demand[0, i], demand[2, i] = left_t[i] / size[0], left_l[i] / size[2]
                t, s, l = t - n, s - 1, l - b
                if not left_t[i]:
                    open_[i], todo = False, todo - 1
            else:
                break
        if not seq:
            raise ValueError("an example exceeds the limits and may not be cut")
        out += split_at_powers(seq) if cut and t * 32 > limits.tokens else [seq]
    return out


def split_at_powers(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cuts a sequence into sequences whose lengths are powers of two, the largest first."""
    out: list[list[tuple[int, int, int]]] = []
    rest = seq[::-1]
    total = sum(n for *_, n in seq)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            i, a, n = rest.pop()
            if n > room:
                rest.append((i, a + room, n - room))
                n = room
            out[-1].append((i, a, n))
            room -= n
    return out


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Packs whole examples (example_id, tokens, loss_tokens): example_id, sequence_id, place in the sequence, offset.

    An example that exceeds a limit raises an error; null counts are taken as 0.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq_id = TaskContext.get().partitionId() << 40
        for b in _blocks(batches, limits.block):
            rows = []
            for seq in pack_block(b["tokens"].fillna(0).to_numpy(), b["loss_tokens"].fillna(0).to_numpy(), limits):
                at = 0
                for k, (i, _, n) in enumerate(seq):
                    rows.append((b["example_id"].iat[i], seq_id, k, at))
                    at += n
                seq_id += 1
            yield pd.DataFrame(rows, columns=["example_id", "sequence_id", "place", "offset"])

    kind = examples.schema["example_id"].dataType.simpleString()
    return examples.select("example_id", "tokens", "loss_tokens").mapInPandas(pack, f"example_id {kind}, sequence_id bigint, place int, offset bigint")


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for b in batches:
        for i in range(0, len(b), size):
            held.append(b.iloc[i : i + size])
            if sum(map(len, held)) >= size:
                yield pd.concat(held, ignore_index=True)
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits()) -> DataFrame:
    """Packs all tokens of all documents, each document followed by id 0: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, one row per piece. tokenizer: path of a byte-level BPE file that every executor can read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(tokenizer)
        seq_id = TaskContext.get().partitionId() << 40
        ids: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq_id
            rows = []
            whole = np.array([len(t) // 4 for t in held], np.int64)
            sums = [np.concatenate(([0], np.cumsum(encode.bears_loss[np.frombuffer(t, "<u4")], dtype=np.int32))) for t in held]
            for seq in pack_block(whole, np.array([x[-1] for x in sums]), limits, sums):
                at = 0
                for i, a, n in seq:
                    rows.append((ids[i], a, n, zlib.crc32(held[i][4 * a : 4 * (a + n)]), int(whole[i]), seq_id, at))
                    at += n
                seq_id += 1
            ids.clear()
            held.clear()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=doc_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for some in slices(batch):
                ids += some["doc_id"].to_pylist()
                held += [t + b"\0\0\0\0" for t in encode([x or "" for x in some["text"].to_pylist()])]
                size += some["text"].nbytes
                if len(held) >= limits.block or size > limits.block_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(pack), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
