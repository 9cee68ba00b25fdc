"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as two vectors: an embedding of the word (a vocabulary from the training rows) and the mean embedding of all its
character n-grams, which also speak for words never seen in training. Runs of over `long` letters (long words, and texts
without blanks) enter as overlapping parts of that length, each a step of its own, so nothing of them is left out. A window of `window` words goes through a gated
recurrent layer in both directions, attention weighs the steps, and a logistic unit scores the pooled state. Every text is
cut into overlapping windows (all of them are scored); the text's score is that of its highest window, calibrated on the
training texts.

Training takes a bounded sample of labelled rows (`positives` and `negatives`, those with the smallest hash of their id; of
rows with one id the smallest text), and `per_text` windows of each. With under about 100 toxic rows the network has too little
to learn from: on the 30 of a table of 1000 documents it scores no better than chance. Only whole texts are labelled, so the windows of a toxic text that teach are those with a word or n-gram that is common in
toxic and rare in other training texts. Scoring runs over all rows, in Arrow batches, with the small model broadcast.

Nulls and empty texts have no windows and score 0. Rows are scored one by one, so repeated rows and ids do not matter. With
no labelled toxic text (or no other) to learn from, every score is 0.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ToxicityRules:
    """window, stride: in words; long: letters of a step; positives, negatives: bounds of the training sample; per_text: windows
    of a text of the sample that teach, drawn at random (of toxic texts those with a telling word); words, grams: bounds of the
    vocabularies; size, hidden: of the embeddings and of a direction's state; epochs, more_epochs: before and after the other
    texts' highest windows join; least_aside: toxic rows from which a fifth of the sample sets the cut; batch, rate, seed."""

    window: int = 32
    stride: int = 24
    long: int = 12
    positives: int = 1200
    negatives: int = 2000
    per_text: int = 3
    words: int = 8000
    grams: int = 12000
    size: int = 12
    hidden: int = 12
    epochs: int = 3
    more_epochs: int = 3
    least_aside: int = 200
    batch: int = 256
    rate: float = 0.01
    seed: int = 11


def steps(text: str | None, long: int = ToxicityRules.long) -> list[str]:
    """The lower-cased words of a text; those of over `long` letters as overlapping parts, the last one up to the end."""
    out = WORD.findall((text or "").lower())
    if max(map(len, out), default=0) <= long:
        return out
    part = lambda w: [w[i : i + long] for i in range(0, len(w) - long, long - 4)] + [w[-long:]]
    return [p for w in out for p in (part(w) if len(w) > long else (w,))]


def char_grams(word: str) -> list[str]:
    w, n = f"<{word}>", len(word)
    return [w[i : i + 3] for i in range(n)] + [w[i : i + 4] for i in range(n - 1)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gram_hashes(words: list[str], long: int) -> np.ndarray:
    """A row for each word of up to `long` letters: hashes of its n-grams of 3 and 4 characters with both ends marked, 0 for none."""
    marked = np.array([f"<{w}>" for w in words], f"<U{long + 2}")
    codes = marked.view(np.uint32).reshape(len(words), long + 2).astype(np.uint64)
    out = []
    for n in (3, 4):
        width = long + 3 - n
        h = np.full((len(words), width), np.uint64(n))
        for k in range(n):
            h = (h ^ codes[:, k : k + width]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(np.where(codes[:, n - 1 :] > 0, h, np.uint64(0)))
    return np.concatenate(out, 1)


class Encoder(dict):
    """From words of up to `long` letters to rows of a table, which has the word's id and its n-gram ids (0: none)."""

    def __init__(self, words: dict[str, int], grams: dict[str, int], long: int = ToxicityRules.long) -> None:
        self.words, self.long, self.most = words, long, 2 * long - 1  # n-grams of 3 and 4 with both ends marked
        known = list(grams)
        own = np.array([_part_hash(g) for g in known], np.uint64)
        order = np.argsort(own)
        self.hashes, self.ids = own[order], np.array([grams[g] for g in known], np.int32)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.word_ids, self.gram_ids = array("i", [0]), array("i", [0] * self.most)  # row 0 is padding

    def learn(self, words: Iterable[str]) -> None:
        """Gives rows to words that have none."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        if not new:
            return
        self.update(zip(new, range(len(self.word_ids), len(self.word_ids) + len(new)), strict=True))
        known = self.words.get
        self.word_ids.extend([known(w, 1) for w in new])
        found = np.zeros((len(new), self.most), np.int32)
        if len(self.hashes):
            h = gram_hashes(new, self.long)
            row, col = np.nonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
            mine = h[row, col]
            at = np.minimum(np.searchsorted(self.hashes, mine), len(self.hashes) - 1)
            found[row, col] = np.where(self.hashes[at] == mine, self.ids[at], 0)
        self.gram_ids.frombytes(found.tobytes())

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The word ids and n-gram ids of all rows."""
        return np.array(self.word_ids), np.array(self.gram_ids).reshape(-1, self.most)

    def __call__(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        except KeyError:
            self.learn(words)
            return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _part_hash(gram: str) -> int:
    h = len(gram)
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


def windows(rows: np.ndarray, rules: ToxicityRules) -> np.ndarray:
    """All overlapping windows of a text's rows, padded with 0."""
    n = len(rows)
    if not n:
        return np.empty((0, rules.window), np.int64)
    starts = np.arange(0, max(1, n - rules.window + rules.stride), rules.stride)
    padded = np.concatenate((rows, np.zeros(rules.window + rules.stride, np.int64)))
    return padded[starts[:, None] + np.arange(rules.window)]


class GatedNetwork:
    """Parameters, forward pass, and gradients."""

    def __init__(self, words: int, grams: int, rules: ToxicityRules) -> None:
        r, e, h = np.random.default_rng(rules.seed), rules.size, rules.hidden
        init = lambda *shape, s=0.1: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"E": init(words, e), "C": init(grams, e), "v": init(h), "A": init(2 * h, h, s=0.2), "o": init(2 * h, s=0.2), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(2 * e, 3 * h, s=0.3), f"U{d}": init(h, 3 * h, s=0.2), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p["E"][0] = self.p["C"][0] = 0
        self.h = h

    def inputs(self, word_ids: np.ndarray, gram_ids: np.ndarray) -> np.ndarray:
        n = np.maximum((gram_ids > 0).sum(1, keepdims=True), 1)
        return np.concatenate((self.p["E"][word_ids], self.p["C"][gram_ids].sum(1) / n), 1, dtype=np.float32)

    def run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """x: (steps, batch, 3h) input projections, in reading order of the direction."""
        h, p = self.h, self.p
        state, out, tape = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape[:2], h), np.float32), []
        for t in range(len(x)):
            u = state @ p[f"U{d}"]
            zr = sigmoid(x[t, :, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * u[:, 2 * h :])
            new = n + z * (state - n)
            m = mask[t]
            new = state + m * (new - state)
            if keep:
                tape.append((state, u, z, r, n))
            state = out[t] = new
        return out, tape

    def logits(self, xf: np.ndarray, xb: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, _ = self.run("f", xf, mask)
        hb, _ = self.run("b", xb[::-1], mask[::-1])
        return self.pool(np.concatenate((hf, hb[::-1]), 2), mask)[0]

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        a = np.tanh(states @ self.p["A"])
        s = a @ self.p["v"] + (mask[:, :, 0] - 1) * 30
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        return pooled @ self.p["o"] + self.p["b"], a, w, pooled

    def gradients(self, word_ids: np.ndarray, gram_ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """word_ids: (steps, batch); gram_ids: (steps, batch, most)."""
        p, h, g = self.p, self.h, {}
        steps, batch = word_ids.shape
        x = self.inputs(word_ids.ravel(), gram_ids.reshape(steps * batch, -1))
        tapes, outs = {}, {}
        for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            proj = (x @ p[f"W{d}"] + p[f"c{d}"]).reshape(steps, batch, -1)
            out, tapes[d] = self.run(d, proj[order], mask[order], keep=True)
            outs[d] = out[order]
        states = np.concatenate((outs["f"], outs["b"]), 2)
        logit, a, w, pooled = self.pool(states, mask)
        dl = (sigmoid(logit) - y) * weight / batch
        g["o"], g["b"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["o"]
        dw = (states * dpool).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        g["v"] = np.einsum("tbh,tb->h", a, ds)
        da = ds[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("tbi,tbh->ih", states, da)
        dstates = w[:, :, None] * dpool + da @ p["A"].T
        dx = np.zeros_like(x)
        for d, order, part in (("f", slice(None), slice(0, h)), ("b", slice(None, None, -1), slice(h, 2 * h))):
            din, m = dstates[:, :, part][order], mask[order]
            dproj, du_all = np.empty((steps, batch, 3 * h), np.float32), np.zeros((h, 3 * h), np.float32)
            carry = np.zeros((batch, h), np.float32)
            for t in range(steps - 1, -1, -1):
                state, u, z, r, n = tapes[d][t]
                dh = din[t] + carry
                dnew = dh * m[t]
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (state - n) * z * (1 - z)
                dr = dn * u[:, 2 * h :] * r * (1 - r)
                dproj[t, :, :h], dproj[t, :, h : 2 * h], dproj[t, :, 2 * h :] = dz, dr, dn
                du = np.concatenate((dz, dr, dn * r), 1)
                du_all += state.T @ du
                carry = dh * (1 - m[t]) + dnew * z + du @ p[f"U{d}"].T
            flat = dproj[order].reshape(steps * batch, -1)
            g[f"U{d}"], g[f"W{d}"], g[f"c{d}"] = du_all, x.T @ flat, flat.sum(0)
            dx += flat @ p[f"W{d}"].T
        e = p["E"].shape[1]
        g["E"] = _scatter(word_ids.ravel(), dx[:, :e], len(p["E"]))
        gi = gram_ids.reshape(steps * batch, -1)
        n = np.maximum((gi > 0).sum(1), 1)
        g["C"] = _scatter(gi.ravel(), np.repeat(dx[:, e:] / n[:, None], gi.shape[1], 0), len(p["C"]))
        g["E"][0] = g["C"][0] = 0
        return g


def _scatter(ids: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(ids, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


@dataclass
class ToxicityModel:
    words: dict[str, int]
    grams: dict[str, int]
    network: GatedNetwork | None
    slope: float
    shift: float
    rules: ToxicityRules

    def scores(self, texts: list[str | None], encoder: Encoder | None = None) -> np.ndarray:
        """The score of each whole text."""
        if self.network is None:
            return np.zeros(len(texts))
        top = self.raw(texts, encoder or Encoder(self.words, self.grams, self.rules.long))
        return np.where(np.isfinite(top), sigmoid(self.slope * top + self.shift), 0.0)

    def raw(self, texts: list[str | None], encoder: Encoder) -> np.ndarray:
        """The highest logit of each text's windows; -inf without words."""
        split = [steps(t, self.rules.long) for t in texts]
        encoder.learn(w for s in split for w in s)
        cut = [windows(encoder(s), self.rules) for s in split]
        counts = np.array([len(c) for c in cut])
        best = np.full(len(texts), -np.inf)
        if not counts.sum():
            return best
        logit = self.logits_of(np.concatenate(cut), encoder)
        np.maximum.at(best, np.repeat(np.arange(len(texts)), counts), logit)
        return best

    def logits_of(self, rows: np.ndarray, encoder: Encoder) -> np.ndarray:
        """The logit of each window."""
        net = self.network
        # input projections once for each distinct word
        distinct, where = np.unique(rows, return_inverse=True)
        where = where.reshape(rows.shape)
        word_ids, gram_ids = np.frombuffer(encoder.word_ids, np.int32)[distinct], np.frombuffer(encoder.gram_ids, np.int32).reshape(-1, encoder.most)[distinct]
        x = net.inputs(word_ids, gram_ids)
        proj = {d: x @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}
        logit = np.empty(len(rows))
        for i in range(0, len(rows), 2048):
            at = where[i : i + 2048].T
            mask = (rows[i : i + 2048].T > 0)[:, :, None].astype(np.float32)
            logit[i : i + 2048] = net.logits(proj["f"][at], proj["b"][at], mask)
        return logit


def train(texts: list[str | None], labels: list[int], rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    """Fits a model to whole texts with labels 0 and 1."""
    y = np.array(labels, np.float32)
    if not (0 < y.sum() < len(y)):
        return ToxicityModel({}, {}, None, 0.0, 0.0, rules)
    # a fifth of the sample, if it is large, sets the cut between both labels
    aside = np.array([zlib.crc32((t or "").encode("utf-8", "replace")) % 5 == 0 for t in texts]) & (y.sum() >= rules.least_aside)
    checked, texts, labels, y = [(texts[i], labels[i]) for i in np.flatnonzero(aside)], [t for t, x in zip(texts, aside, strict=True) if not x], [l for l, x in zip(labels, aside, strict=True) if not x], y[~aside]
    split = [steps(t, rules.long) for t in texts]
    seen = [set(s) for s in split]
    word_n, gram_n, word_y, gram_y = Counter(), Counter(), Counter(), Counter()
    for s, l in zip(seen, labels, strict=True):
        g = {x for w in s for x in char_grams(w)}
        word_n.update(s)
        gram_n.update(g)
        if l:
            word_y.update(s)
            gram_y.update(g)
    pos, neg = y.sum(), len(y) - y.sum()
    least = max(3, int(0.02 * pos))
    lift = lambda n, k: k >= least and k / pos > 12 * (n - k + 0.5) / neg
    telling_words = {w for w, k in word_y.items() if lift(word_n[w], k)}
    telling_grams = {g for g, k in gram_y.items() if len(g) == 4 and k >= 5 and lift(gram_n[g], k)}
    ranked = lambda n, keep: sorted((x for x, k in n.items() if k >= 2), key=lambda x: (-n[x], x))[:keep]
    words = {w: i + 2 for i, w in enumerate(dict.fromkeys([*sorted(telling_words), *ranked(word_n, rules.words)]))}
    grams = {g: i + 1 for i, g in enumerate(dict.fromkeys([*sorted(telling_grams), *ranked(gram_n, rules.grams)]))}
    encoder, random = Encoder(words, grams, rules.long), np.random.default_rng(rules.seed)
    telling = lambda w: w in telling_words or not telling_grams.isdisjoint(char_grams(w))
    known: dict[str, bool] = {}
    picked, target = [], []
    for s, l in zip(split, labels, strict=True):
        cut = windows(encoder(s), rules)
        if not len(cut):
            continue
        if l:
            for w in s:
                if w not in known:
                    known[w] = telling(w)
            hit = windows(np.array([1 if known[w] else 0 for w in s], np.int64), rules).any(1)
            cut = cut[hit]
        take = random.permutation(len(cut))[: rules.per_text]
        picked.append(cut[take])
        target += [l] * len(take)
    rows, t = np.concatenate(picked), np.array(target, np.float32)
    if not (0 < t.sum() < len(t)):
        return ToxicityModel({}, {}, None, 0.0, 0.0, rules)
    word_ids, gram_ids = encoder.table()
    net = GatedNetwork(len(words) + 2, len(grams) + 1, rules)
    model = ToxicityModel(words, grams, net, 1.0, 0.0, rules)
    _fit(net, rows, t, word_ids, gram_ids, rules, rules.epochs, random)
    # the other texts' highest windows are the hard cases: learn them too
    others = [windows(encoder(s), rules) for s, l in zip(split, labels, strict=True) if not l and s]
    hard = np.stack([cut[int(model.logits_of(cut, encoder).argmax())] for cut in others]) if others else rows[:0]
    _fit(net, np.concatenate((rows, hard)), np.concatenate((t, np.zeros(len(hard), np.float32))), word_ids, gram_ids, rules, rules.more_epochs, random)
    if checked:
        texts, y = [t for t, _ in checked], np.array([l for _, l in checked], np.float32)
    top = model.raw(texts, encoder)
    model.shift = -_cut(top[np.isfinite(top)], y[np.isfinite(top)])
    return model


def _fit(net: GatedNetwork, rows: np.ndarray, t: np.ndarray, word_ids: np.ndarray, gram_ids: np.ndarray, rules: ToxicityRules, epochs: int, random: np.random.Generator) -> None:
    """Adam over shuffled batches; both labels weigh the same in all."""
    weight = np.where(t > 0, 0.5 / t.mean(), 0.5 / (1 - t.mean())).astype(np.float32)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, batches = 0, max(1, len(rows) // rules.batch)
    for _ in range(max(epochs, -(-100 // batches))):  # few rows need more rounds
        for some in np.array_split(random.permutation(len(rows)), batches):
            r, step = rows[some].T, step + 1
            g = net.gradients(word_ids[r], gram_ids[r], (r > 0)[:, :, None].astype(np.float32), t[some], weight[some])
            for k, d in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                net.p[k] -= (rules.rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _cut(top: np.ndarray, y: np.ndarray) -> float:
    """The logit that splits the training texts with the highest F1 (between two neighbours)."""
    order = np.argsort(-top, kind="stable")
    s, hit = top[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    k = int(f1.argmax())
    return float((s[k] + s[min(k + 1, len(s) - 1)]) / 2)


def held_out(doc_id: Column) -> Column:
    """Rows never trained on: crc32 of the id as text is a multiple of 5. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rules: ToxicityRules) -> list[tuple[str, int]]:
    """The bounded sample: texts and labels, collected to the driver."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic", F.xxhash64(F.lit(rules.seed), "doc_id").alias("h")).distinct()
    picked = [usable.where(F.col("toxic") == l).orderBy("h", "doc_id").limit(n) for l, n in ((1, rules.positives), (0, rules.negatives))]
    sample = picked[0].union(picked[1]).select("doc_id", "toxic")  # at most positives + negatives rows
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # no more rows than the sample, whatever repeats
    return sorted(((r["text"] or "", int(r["toxic"])) for r in rows), key=lambda x: (x[1], x[0]))


def score_toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs (doc_id, text); labels: doc_id, toxic."""
    sample = training_rows(docs, labels, rules)
    model = docs.sparkSession.sparkContext.broadcast(train([t for t, _ in sample], [l for _, l in sample], rules))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        encoder = Encoder(held.words, held.grams, held.rules.long)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                if len(encoder) > 200_000:
                    encoder.clear()
                s = held.scores(part["text"].to_pylist(), encoder)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
