"""The repository source: slices of large files, pushed filters, balanced batches of commits, the stream of new commits and the
state of secrets over its batches."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from leakscan.operators.dedup import collapse_commits, line_findings
from leakscan.sources import history
from leakscan.sources.repo import CommitStream, RepoReader, binary_head, commit_stream, file_lines, is_binary, repo_lines
from leakscan.streaming.findings import secret_states

SECRET = "Zx9" + "kQ2mV7pL4wT8r"


def git(root, *args):
    done = subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)
    return done.stdout.decode().strip()


def commit(root, files, message="m"):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git(root, "add", "-A")
    git(root, "commit", "-qm", message)
    return git(root, "rev-parse", "HEAD")


@pytest.fixture
def root(tmp_path):
    made = tmp_path / "repo"
    made.mkdir()
    git(made, "init", "-q", "-b", "main")
    return made


# --- large files -----------------------------------------------------------------------------------------------------


def test_ranges_of_a_file_make_up_its_lines(tmp_path):
    r = random.Random(1)
    for n in range(60):
        data = b"".join(r.choice([b"a", b"bc" * 9, b"\n", b"\r", b"\r\n", b"\xc3\xa9", b"a\xff", b" "]) for _ in range(r.randrange(60)))
        (tmp_path / "f").write_bytes(data)
        whole = [line for _, line in file_lines(str(tmp_path), "f")]
        text = data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert is_binary(data) or whole == (text[:-1] if not text[-1] else text)
        for size in (1, 2, 3, 7, 100):
            for piece in (1, 4, 1000):
                cut = [list(file_lines(str(tmp_path), "f", a, a + size, piece)) for a in range(0, len(data), size)]
                assert [line for lines in cut for _, line in lines] == whole and all([i for i, _ in x] == list(range(1, len(x) + 1)) for x in cut)


def test_slices_give_the_same_rows_for_any_size(spark, tmp_path):
    r = random.Random(2)
    (tmp_path / "big.txt").write_text("".join(r.choice(["x\n", "longer line\r\n", "\n", "é" * 40 + "\r"]) for _ in range(400)))
    (tmp_path / "also.txt").write_text("one long line " * 100 + "\nlast")
    (tmp_path / "small").write_text("a\nb\n")
    (tmp_path / "blob").write_bytes(b"\0" * 5000)
    whole = sorted(map(tuple, repo_lines(spark, str(tmp_path), split_bytes=0).collect()))
    for size in (64, 333, 4000):
        for rows in (100_000, 0):  # both ways to join the first line numbers
            assert sorted(map(tuple, repo_lines(spark, str(tmp_path), split_bytes=size, broadcast_rows=rows).collect())) == whole
    reader = RepoReader({"path": str(tmp_path), "mode": "slices", "split_bytes": "333"})
    assert max(p.end - p.start for p in reader.partitions()) == 333 and len(reader.partitions()) > 15


def test_binary_column_equals_the_test_of_bytes(spark):
    r = random.Random(3)
    heads = [b"", b"a\0b", "é".encode() * 9, *(bytes(r.randrange(256) if r.random() < p else 65 for _ in range(60)) for p in (0.1, 0.5, 0.9) for _ in range(30)), *(bytes([9] * k + [1] * (100 - k)) for k in range(60, 80))]
    df = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(heads)], "i int, head binary")
    assert [x.b for x in df.select("i", binary_head(F.col("head")).alias("b")).orderBy("i").collect()] == [is_binary(h) for h in heads]


# --- pushed filters --------------------------------------------------------------------------------------------------


def test_filters_reach_the_listing(spark, root):
    for i in range(6):
        head = commit(root, {f"src/a{i}.py": f"x = {i}\n", f"doc/b{i}.md": "text\n"}, f"c{i}")
    from leakscan.sources import repo

    def read(mode, **more):
        spark.dataSource.register(repo.RepoLines)
        repo_lines(spark, str(root))
        return spark.read.format("repo_lines").options(path=str(root), mode=mode, batch="1", patterns=json.dumps([".git/"]), **more).load()

    for mode, where, most in (
        ("tree", "file_path = 'src/a3.py'", 1), ("tree", "file_path like 'src/%'", 6), ("tree", "file_path in ('doc/b1.md', 'none')", 1), ("tree", "commit_hash is not null", 0), ("tree", "file_path like '%b2%'", 1), ("tree", "not file_path like 'src/%'", 6),
        ("history", f"commit_hash = '{head[:12]}'", 1), ("history", "file_path like '%a4.py'", 1), ("history", "commit_hash is null", 0), ("history", f"commit_hash <> '{head[:12]}'", 5), ("history", "file_path = 'src/a0.py' or line_number = 1", 6),
    ):
        every = read(mode)
        kept = every.where(where)
        want = sorted(map(tuple, spark.createDataFrame(every.collect(), every.schema).where(where).collect()))
        assert sorted(map(tuple, kept.collect())) == want, where
        assert kept.rdd.getNumPartitions() <= max(most, 1) and (where.endswith("= 1") or most == 0 or kept.rdd.getNumPartitions() == most), where


# --- history ---------------------------------------------------------------------------------------------------------


def skewed(root):
    r = random.Random(5)
    line = lambda: f"value_{r.randrange(10**9)} = {r.random()}\n"
    commit(root, {f"lib/f{i}.py": "".join(line() for _ in range(60)) for i in range(40)} | {"é/ü.txt": "a\n", "moved/from.txt": "".join(line() for _ in range(50))}, "import")
    for i in range(12):
        commit(root, {f"lib/f{i}.py": (root / f"lib/f{i}.py").read_text() + line(), f"new{i}.txt": "x\n"}, f"small {i}")
    git(root, "mv", "moved/from.txt", "moved/to.txt")
    commit(root, {f"lib/f{i}.py": "".join(line() for _ in range(80)) for i in range(30)} | {"moved/to.txt": (root / "moved/to.txt").read_text() + line()}, "rewrite")
    git(root, "checkout", "-qb", "side", "HEAD~3")
    commit(root, {"side.txt": "s\n"})
    git(root, "checkout", "-q", "main")
    git(root, "merge", "-q", "--no-edit", "side")


def test_history_is_cut_by_weight_and_its_rows_stay(spark, root):
    skewed(root)
    read = lambda **o: [row for reader in [RepoReader({"path": str(root), "mode": "history"} | o)] for p in reader.partitions() for row in reader.read(p)]
    whole = read(batch_bytes=str(10**9))
    plain = list(history.added_lines(subprocess.run(["git", "-C", str(root), "-c", "core.quotePath=false", "log", "-p", "--all", "--no-color", "--unified=0"], capture_output=True, check=True, text=True).stdout.splitlines(), lambda p: True))
    assert [x[:4] for x in sorted(whole, key=lambda x: x[4])] == plain and {"é/ü.txt", "moved/to.txt"} <= {x[0] for x in whole}
    for size in (500, 6000, 20_000):
        got = read(batch_bytes=str(size))
        assert [x[:4] for x in sorted(got, key=lambda x: x[4])] == plain and len({x[4] for x in got}) == len(got)
        parts = RepoReader({"path": str(root), "mode": "history", "batch_bytes": str(size)}).partitions()
        largest = max(w for c in history.weighed(str(root), git(root, "rev-list", "--all").split()) for *_, w in c.files)
        assert max(p.weight for p in parts) <= max(size, largest)
        if size == 6000:  # tasks of about equal weight: the largest is no more than a few times the mean
            assert max(p.weight for p in parts) <= 3 * sum(p.weight for p in parts) / len(parts)
    assert [len(p.commits) for p in RepoReader({"path": str(root), "mode": "history", "batch": "5", "max_commits": "7"}).partitions()][:1] == [5]
    rows = repo_lines(spark, str(root), "history", ["lib/"]).collect()
    assert sorted(tuple(r)[:4] for r in rows) == sorted(x for x in plain if not x[0].startswith("lib/"))


# --- streams ---------------------------------------------------------------------------------------------------------


def run(df, folder, mode="append"):
    """One run of a stream over all that is there, restarted from its checkpoint; gives the rows of this run by batch."""
    rows = []

    def keep(batch, n):
        rows.extend((n, *r) for r in batch.collect())

    query = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows


def test_stream_sees_each_added_line_once(spark, root, tmp_path):
    check, seen = tmp_path / "check", []
    stream = lambda: commit_stream(spark, str(root), ["skip/"])
    assert run(stream(), tmp_path / "none") == []  # no commit yet
    commit(root, {"a.txt": "1\n2\n", "skip/b.txt": "no\n"})
    commit(root, {"a.txt": "1\n2\n3\n"})
    seen.append(run(stream(), check))
    assert run(stream(), check) == []  # a restart without news
    git(root, "checkout", "-qb", "side", "HEAD~1")
    commit(root, {"side.txt": "s\n"})
    seen.append(run(stream(), check))
    git(root, "checkout", "-q", "main")
    git(root, "merge", "-q", "--no-edit", "side")
    commit(root, {"a.txt": "1\n2\n3\n4\n"})
    git(root, "branch", "-D", "side")
    seen.append(run(stream(), check))
    assert [sorted(r[4] for r in rows) for rows in seen] == [["1", "2", "3"], ["s"], ["4"]]
    rows = [r[1:5] for batch in seen for r in batch]
    assert sorted(rows) == sorted(tuple(r)[:4] for r in repo_lines(spark, str(root), "history", ["skip/"]).collect()) and len(rows) == len(set(rows))
    # newer commits come first in the order of keys
    keys = {r[4]: r[5] for batch in seen for r in batch}
    assert keys["4"] < keys["s"] and keys["4"] < keys["3"] < keys["1"] < keys["2"]


def test_commits_between_batches_and_rewritten_branches(root):
    commit(root, {"a": "1\n"})
    old = commit(root, {"a": "1\n2\n"})
    source = CommitStream({"path": str(root)})
    assert source.initialOffset() == {"tips": [], "count": 0}
    first = source.latestOffset()
    assert first == {"tips": [old], "count": 2}
    git(root, "reset", "-q", "--hard", "HEAD~1")
    new = commit(root, {"a": "1\nx\n"})
    second = source.latestOffset()
    assert second == {"tips": sorted([old, new]), "count": 3}
    rows = lambda a, b: [r[3] for p in source.partitions(a, b) for r in source.read(p)]
    assert rows(source.initialOffset(), first) == ["1", "2"] and rows(first, second) == ["x"] and rows(second, second) == []
    assert json.loads(json.dumps(second)) == second
    gone = {"tips": ["0" * 40, old], "count": 2}  # a tip that was collected as garbage
    assert rows(gone, second) == ["x"]


def test_states_of_secrets_equal_the_pass_over_all_commits(spark, root, tmp_path):
    r, check, lines, latest = random.Random(7), tmp_path / "check", [], {}
    secrets = [f"{SECRET}{i}" for i in range(5)]
    say = lambda s: r.choice([f'token = "{s}"\n', f"password: '{s}'\n", f'x = f("{s}", secret)\n'])
    for _ in range(3):
        for _ in range(r.randrange(1, 4)):
            files = {f"f{r.randrange(3)}.py": "".join(say(r.choice(secrets)) for _ in range(r.randrange(1, 5))) + f"# {r.random()}\n" for _ in range(2)}
            commit(root, files)
        stream = commit_stream(spark, str(root))
        for _, *row in run(secret_states(stream), check / "state", "update"):
            latest[row[2], row[1]] = tuple(row)
        lines += [x[1:] for x in run(commit_stream(spark, str(root)), check / "lines")]
    whole = spark.createDataFrame(lines, "file_path string, commit_hash string, line_number int, line_content string, seq bigint")
    want = collapse_commits(line_findings(whole))
    names = ["detector_type", "matched_string", "file_path", "line_number", "commit_hash", "line_content", "entropy_score", "start_col", "end_col", "occurrences", "history_commits", "seq", "rank"]
    assert len(latest) > 4 and sorted(map(repr, latest.values())) == sorted(repr(tuple(x)) for x in want.select(*names).collect())
    assert max(x[9] for x in latest.values()) > 1 and max(len(x[10]) for x in latest.values()) > 1
