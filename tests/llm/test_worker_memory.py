"""What Python workers hold while they work, and what they keep after."""

import tracemalloc

import numpy as np
import pyarrow as pa

from leakscan.llm import common
from leakscan.llm.decontam import Words
from leakscan.llm.jaccard import word_hashes


def test_word_hashes_of_a_large_text_hold_little_beside_it():
    data = (b"x" * 1000 + b" ") * 4000
    tracemalloc.start()
    hashes, firsts = word_hashes(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(hashes.tolist())) == 1 and np.array_equal(firsts, np.arange(4000) * 1001)
    assert peak < 15_000_000


def test_kept_words_are_few():
    words, one = Words(), Words()
    for n in range(0, 400_000, 1000):
        text = " ".join(f"w{i}" for i in range(n, n + 1000))
        got = words(text)
    assert np.array_equal(got, one(text)) and len(words.known) < 150_000


def test_memory_is_given_back_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (5, 0, 3)]
    out = list(common.lean(lambda bs: (s for b in bs for s in common.slices(b, 2)))(iter(batches)))
    assert [x for b in out for x in b["x"].to_pylist()] == [0, 1, 2, 3, 4, 0, 1, 2] and len(calls) == 4
