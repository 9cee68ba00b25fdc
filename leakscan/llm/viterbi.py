"""Token counts of a unigram tokenizer without its tokens: count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character of a word; dynamic programming carries the
best score and, with it, only the number of pieces. Ties follow the tokenizer: of equal scores the path whose last piece
started first (the longest) stays; a character that is no piece of its own may be unknown, at the lowest score less 10, and
neighbouring unknowns are one token. Scores are summed from the left in double precision, as the tokenizer sums them.

Texts are cut before every blank into words that each start with the blank mark; no piece holds a mark elsewhere than in
front, so words are counted alone, and the counts of words are kept up to a bound.

Nulls and empty texts have 0 tokens. Repeated rows and ids are counted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: what an unknown costs beyond the lowest score
_WORD = re.compile(f"{MARK}[^{MARK}]*|[^{MARK}]+")


def ranked_vocabulary(model_file: str, limit: int | None = None) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file in their order, scored by rank (Zipf's rule); special and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [sp.id_to_piece(i) for i in ids]
    return [(p, -float(np.log(n + 10.0))) for n, p in enumerate(pieces[:limit]) if MARK not in p[1:] or set(p) == {MARK}]


class TokenCounter:
    """Counts tokens of texts for a vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], keep: int = 500_000) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and set(piece[1:]) != {MARK}:  # a run of marks lies across words
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}
        self.keep = keep

    def word(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count, last_unknown = [0] * (n + 1), [False] * (n + 1)
        matches = iter(self.automaton.iter(word)) if len(self.automaton) else iter(())
        at, piece = next(matches, (n, None))
        for end in range(n):
            top: float | None = None
            while at == end and piece is not None:  # the longest piece comes first
                size, score = piece
                start = end + 1 - size
                if best[start] is not None and (top is None or best[start] + score > top):
                    top, count[end + 1] = best[start] + score, count[start] + 1
                at, piece = next(matches, (n, None))
            if word[end] not in self.single and best[end] is not None and (top is None or best[end] + self.unknown > top):
                top, last_unknown[end + 1] = best[end] + self.unknown, True
                count[end + 1] = count[end] + (not last_unknown[end])
            best[end + 1] = top
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        words, known = _WORD.findall(text if text[0] == MARK else MARK + text), self.known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
            return sum([known[w] for w in words])


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_chars (code points), n_tokens: one row per row of docs (doc_id, text). The vocabulary is a parameter of some
    ten thousand pieces and is sent to the executors."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(held.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_chars": [len(t or "") for t in b["text"]], "n_tokens": [counter(t) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, n_chars bigint, n_tokens bigint")
