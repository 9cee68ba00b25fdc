"""Merkle manifest, prefix trie and best-fit packing against brute force; nulls, ties, repeated rows, empty and long inputs."""

import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from leakscan.llm import bestfit, merkle, queries, sql, trie
from leakscan.llm.common import scanned

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tie string"
TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, node string"
NULLS_FIRST = lambda v: (v is not None, v if v is not None else 0)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


# --- 11 ----------------------------------------------------------------------------------------------------------------


def leaf_of(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS])


def tree(digests, fan):
    """The root, and each leaf's siblings by level, left and right of it."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = range(i // fan * fan, min(i // fan * fan + fan, len(level)))
            paths[k].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
            at[k] = i // fan
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], paths


def brute_manifest(rows, fan=3):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (NULLS_FIRST(r["doc_id"]), leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in by[s]], fan)
    root, above = tree([trees[s][0] for s in sources], fan) if sources else ("", [])
    out = []
    for s, upper in zip(sources, above, strict=True):
        for r, own in zip(by[s], trees[s][1], strict=True):
            d = leaf_of(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                d = leaf_of({**r.asDict(), "text": r["text"].replace("\n", "")})
            for left, right in own + upper:
                d = h(left, d, right)
            out.append((r["doc_id"], leaf_of(r), trees[s][0], root, h(*[a + b for a, b in own + upper]), d, d == root))
    return sorted(map(repr, out))


def documents(spark, seed, n, sources):
    r = random.Random(seed)
    rows = [(r.choice([None, r.randrange(2 * n)]), r.choice([None, "", "a\nb", "é\n" * r.randrange(9), f"text {r.random()}\n"]), r.choice([None, "en"]), r.choice(sources), r.choice([None, 7]), "clash", "t") for _ in range(n)]
    rows += rows[: n // 5]  # repeated rows
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize(("n", "sources", "rules"), [
    (1, [None], merkle.TreeRules()),
    (90, ["s"], merkle.TreeRules(per_task=8, levels=1)),
    (150, [None, "", "a", "b", "\U0001f600", "￿"], merkle.TreeRules(per_task=9, levels=2)),
    (120, [f"s{i}" for i in range(60)], merkle.TreeRules(fan=2, per_task=40)),
])
def test_manifest_equals_brute_force(spark, n, sources, rules):
    docs = documents(spark, n, n, sources)
    assert sorted(repr(tuple(r)) for r in merkle.verified_digests(docs, rules).collect()) == brute_manifest(docs.collect(), rules.fan)


def test_manifest_as_a_table_proves_its_leaves(spark):
    docs = documents(spark, 5, 60, ["x", "y"])
    made = merkle.merkle_manifest(docs, merkle.TreeRules(per_task=7))
    again = merkle.folded(merkle.F.col("leaf"), merkle.F.col("proof"))
    assert made.where(again != merkle.F.col("root")).count() == 0 and made.count() == docs.count()
    assert sorted(r["place"] for r in made.where("source = 'x'").collect()) == list(range(docs.where("source = 'x'").count()))
    assert merkle.merkle_manifest(docs.limit(0)).count() == merkle.verified_digests(docs.limit(0)).count() == 0


def test_running_totals_go_on_over_partitions(spark):
    r = random.Random(2)
    rows = sorted((r.randrange(4), r.randrange(9)) for _ in range(80))
    for parts in (1, 7, 90):  # 90: some partitions are empty
        got = scanned(spark.sparkContext.parallelize(rows, parts), lambda x: x[0], lambda x: x[1], lambda a, b: a + b, 0).collect()
        for k, (row, before, total) in enumerate(got):
            assert row == rows[k] and before == sum(v for g, v in rows[:k] if g == row[0]) and total == before + row[1]


# --- 12 ----------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    convs = {}
    for r in rows:
        if r["conv_id"] is not None:
            convs.setdefault(r["conv_id"], []).append(r)
    what = lambda r: (r["role"] or "", r["text"] or "")
    md5 = lambda r: __import__("hashlib").md5(f"{len(what(r)[0].encode())}:{''.join(what(r))}".encode()).hexdigest()
    own = {c: [what(r) for r in sorted(rs, key=lambda r: (NULLS_FIRST(r["turn"]), md5(r)))] for c, rs in convs.items()}
    members = {}
    for c in own:
        n = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = own.get(base, [])[:n] + own[c][n:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((c, d == len(seq)))
    kids, out = {}, []
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p, held in members.items():
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += q not in kids
            saved += (len(members[q]) - 1) * len(q[-1][1]) if q else 0
            todo += kids.get(q, [])
        ends = ",".join(str(c) for c, last in sorted(held) if last)
        out.append((min(held)[0], len(p), min(members[p[:-1]])[0] if p else None, len(held), len(kids.get(p, [])), leaves, saved, h(ends)))
    return sorted(map(repr, out))


def checked_trie(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)
    got = trie.prefix_trie(df)
    held = got.collect()
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(repr(tuple(r[c] for c in cols)) for r in held) == brute_trie(df.collect())
    # preorder: places are gapless, and each interval holds its subtree
    assert sorted(r["place"] for r in held) == list(range(len(held)))
    for r in held:
        assert r["end"] - r["place"] + 1 == 1 + sum(r["place"] < x["place"] <= r["end"] for x in held)


def test_trie_equals_brute_force(spark):
    r = random.Random(4)
    say = ["", None, "a", "ab", "é\U0001f600", "b" * 50]
    rows = [(c, r.choice([None, t, t, t]), r.choice(["user", "bot", None]), r.choice(say)) for c in [*range(30), 99, 100, 105, 250, -3, 7000] for t in range(r.randrange(1, 9))]
    rows += [(500 + c, t, "user", "same") for c in range(40) for t in range(3)]  # copies
    rows += [(None, 1, "user", "x"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    checked_trie(spark, rows)


def test_trie_of_long_conversations(spark):
    long = [(0, t, "u", f"{t % 7}") for t in range(3000)]
    long += [(c, t, "u", f"{t % 7}" if t < 2990 - 400 * k else f"other {k}") for k, c in enumerate((2, 3, 4)) for t in range(2995 - 400 * k)]
    df = spark.createDataFrame([(*x, "", "") for x in long], TURNS)
    got = trie.prefix_trie(df)
    assert got.count() == got.select("place").distinct().count() and got.agg({"depth": "max"}).first()[0] == 3000
    root = got.where("depth = 0").first()
    assert root["n_convs"] == 4 and root["n_leaves"] == 4 and root["end"] == got.count() - 1
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_every_sql_equals_its_query(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert con.execute(f"select {sql.crc32('i::VARCHAR')} from range(0, 3000, 7) t(i)").fetchall() == [(zlib.crc32(str(i).encode()),) for i in range(0, 3000, 7)]
    for name in queries.oracle_sql():
        got = queries.queries()[name](spark, sf)
        cols = sorted(got.columns)
        assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == sorted(map(repr, con.execute(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()))


# --- 13 ----------------------------------------------------------------------------------------------------------------


def test_word_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    r, slow, own = random.Random(3), Tokenizer.from_file(WORDS), bestfit.WordTokenizer(WORDS, 1000)
    parts = ["a", "B", "É", "ß", "İ", "ı", "Σ", "'s", "'", "'LL", " ", "  ", "\n", "\x00", "\x01", "²", "½", "ª", "_", "-", "!", "1", "23", "́", "e", "ﬁ", "中", "😀", "<|endoftext|>", "<|", "\x85", "\xa0", "​", "\xad", "\x1c", "ǅ", "µ", "ſ", "."]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        assert np.frombuffer(own(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


def checked_bins(rows, texts, room):
    from tokenizers import Tokenizer

    slow, seqs, by = Tokenizer.from_file(WORDS), {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
        by.setdefault(r["doc_id"], []).append(r)
    for held in seqs.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [sum(x["length"] for x in held[:i]) for i in range(len(held))] and sum(r["length"] for r in held) <= room
    for i, t in enumerate(texts):
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        cut = [ids[a : a + room] for a in range(0, len(ids), room)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in sorted(by[i], key=lambda r: r["piece"])] == [(k, k * room, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(cut)]
    return len(seqs)


def test_documents_meet_in_few_sequences(spark):
    r = random.Random(7)
    texts = [None, "", " ", "x " * 300, "<|endoftext|> a", *[" ".join(r.choice(["lorem", "ipsum,", "Dolor", "é", "x1"]) for _ in range(r.randrange(1, 60))) for _ in range(300)]]
    texts += texts[5:25]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "clash", "tie") for i, t in enumerate(texts)], DOCS)
    for rules, more in ((bestfit.BinRules(tokens=64, open_from=8), 1.03), (bestfit.BinRules(tokens=64, block=32, open_from=8), 1.06)):
        rows = bestfit.bin_documents(df, WORDS, rules).collect()
        assert checked_bins(rows, texts, 64) <= more * -(-sum(x["length"] for x in rows) // 64)
    assert bestfit.bin_documents(df.limit(0), WORDS).count() == 0


def test_swaps_empty_bins_that_best_fit_leaves():
    r = np.random.default_rng(1)
    used = set()
    for sizes, room in ((r.integers(1000, 2500, 500), 4096), (r.integers(1, 4096, 500), 4096), (np.array([6, 6, 4, 4, 5, 5]), 10), (r.integers(1, 30, 600), 100)):
        start = bestfit.best_fit(sizes, room)
        search = bestfit.SwapSearch(sizes, start, room, under=1)
        squares = int((search.fill**2).sum())
        end = search.run()
        fill = np.bincount(end, weights=sizes)
        assert fill.max() <= room and (search.fill[: len(fill)] == fill).all() and (fill**2).sum() >= squares
        assert -(-sizes.sum() // room) <= (fill > 0).sum() <= start.max() + 1
        used |= {k for k, n in search.steps.items() if n}
    assert used == {"move", "one for one", "one for two", "two for one"}
    sizes = r.integers(1000, 2500, 500)
    before = bestfit.best_fit(sizes, 4096).max() + 1
    assert len(bestfit.pack_sizes(sizes, bestfit.BinRules())) < 0.95 * before  # sizes that best fit alone places badly
