"""Scans of folders and git repositories, reports, the command line, fixes and streams."""

import json
import subprocess

import pytest

from leakscan import api, cli
from leakscan.operators.fix import apply_fix
from leakscan.report import render
from leakscan.report.render import report
from leakscan.sources.ignore import IgnoreRules, rule
from leakscan.sources.repo import RepoReader, ScanError, is_binary, repo_lines, resolve_target, staged_paths

SECRET = "Zx9" + "kQ2mV7pL4wT8r"


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    git(root, "init", "-q")
    (root / ".env").write_text(f"API_TOKEN={SECRET}\n")
    (root / "src" / "old.py").write_text(f'password = "{SECRET}x"\n')
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    (root / "src" / "old.py").write_text("import os\nprint(1)\n")
    (root / "node_modules" / "a.js").write_text(f'token = "{SECRET}"\n')
    (root / "blob").write_bytes(b"\0" + f'token = "{SECRET}"'.encode())
    (root / "src" / "new.py").write_bytes(f'# \xff\r\nclient.token = "{SECRET}y"\r\n'.encode("latin-1"))
    git(root, "add", "src")
    git(root, "commit", "-qm", "two")
    return root


def test_tree_scan(spark, repo):
    rows = repo_lines(spark, str(repo), patterns=[".git/", "node_modules/"]).collect()
    assert [(r.file_path, r.line_number, r.line_content) for r in sorted(rows, key=lambda r: r.seq)] == [(".env", 1, f"API_TOKEN={SECRET}"), ("src/new.py", 1, "# "), ("src/new.py", 2, f'client.token = "{SECRET}y"'), ("src/old.py", 1, "import os"), ("src/old.py", 2, "print(1)")]


def test_scan_with_history(spark, repo):
    found = api.scan(spark, str(repo), api.ScanOptions(history=True))
    rows = {(r.file_path, r.exposure): r for r in found.collect()}
    assert set(rows) == {(".env", "working_tree"), ("src/new.py", "working_tree"), ("src/old.py", "history_only")}
    assert rows[".env", "working_tree"].history_commits and rows[".env", "working_tree"].remediation_steps
    for kind in ("terminal", "json", "sarif", "html"):
        assert SECRET not in report(found, kind)
    sarif = json.loads(report(found, "SARIF"))["runs"][0]
    assert len(sarif["results"]) == 3 and len(sarif["tool"]["driver"]["rules"]) == 14
    assert json.loads(report(found, "json"))[0]["severity"] in ("High", "Critical", "Medium")
    with pytest.raises(ValueError):
        report(found, "pdf")


def test_staged_scan(spark, repo):
    (repo / "s.yml").write_text(f"a: 1\nsecret: '{SECRET}z'\n")
    git(repo, "add", "s.yml")
    rows = api.scan(spark, str(repo), api.ScanOptions(staged=True)).collect()
    assert [(r.file_path, r.line_number, r.commit_hash) for r in rows] == [("s.yml", 2, None)]


def test_command_line(spark, repo, tmp_path, capsys):
    assert cli.main([str(repo), "--fail-on", "low"], spark) == 1
    assert SECRET not in capsys.readouterr().out
    assert cli.main([str(repo), "--update-baseline"], spark) == 0
    assert cli.main([str(repo), "--fail-on", "low", "--format", "json", "--output", str(tmp_path / "o.json")], spark) == 0
    assert json.loads((tmp_path / "o.json").read_text()) == []
    assert cli.main([str(repo), "--history", "--staged"], spark) == 2
    assert cli.main([str(tmp_path / "none")], spark) == 2
    assert cli.main([str(repo), "--min-severity", "odd"], spark) == 2


def test_targets(tmp_path):
    assert resolve_target(str(tmp_path), "x") == str(tmp_path)
    with pytest.raises(ScanError):
        resolve_target(str(tmp_path / "none"), "x")


def test_batches_are_bounded_by_files_and_bytes(tmp_path):
    for i in range(7):
        (tmp_path / f"f{i}").write_text("x" * (10 if i != 3 else 500))
    cut = lambda **o: [[path for _, path in b.units] for b in RepoReader({"path": str(tmp_path)} | o).partitions()]
    assert [len(x) for x in cut(batch="3")] == [3, 3, 1] and [len(x) for x in cut(batch_bytes="25")] == [2, 1, 1, 2, 1]
    assert cut()[0] == [f"f{i}" for i in range(7)] and RepoReader({"path": str(tmp_path)}).partitions()[0].units[0][0] == 0


def test_staged_paths(spark, repo, tmp_path):
    (repo / "odd name.txt").write_text("x")
    git(repo, "add", "odd name.txt")
    assert staged_paths(str(repo)) == ["odd name.txt"] and staged_paths(str(tmp_path / "none")) == []


def test_exposure_in_words():
    base = {"exposure": "working_tree", "history_commits": [], "commit_hash": None}
    told = [render.exposure(base | x) for x in ({}, {"history_commits": ["c1", "c2"]}, {"exposure": "history_only", "commit_hash": "c9", "history_commits": ["c9"]}, {"exposure": "history_only", "commit_hash": "c9", "history_commits": ["c8", "c9"]})]
    assert len(set(told)) == 4 and "c1" in told[1] and "2 commit" in told[1] and "c9" in told[2] and "2 commits" in told[3]


def test_binary():
    assert is_binary(b"a\0b") and is_binary(b"\x01\x02ab") and not is_binary(b"") and not is_binary("é".encode() * 9)


@pytest.mark.parametrize(("patterns", "path", "want"), [(["*.log"], "a/b.log", True), (["*.log", "!keep.log"], "keep.log", False), (["/top"], "a/top", False), (["/top"], "top/x", True), (["build/"], "a/build/x", True), (["build/"], "build", False), (["a/**/z"], "a/b/c/z", True), (["**/z"], "z", True), (["f?o"], "fxo", True), (["[ab].c"], "b.c", True), (["# c", ""], "# c", False), (["a\\b"], "ab", True)])
def test_ignore_rules(spark, patterns, path, want):
    assert IgnoreRules(patterns)(path) is want
    assert rule("# x") is None


def test_fix(spark, tmp_path):
    (tmp_path / "a.py").write_text(f'from x import y\ntoken = "{SECRET}"\n')
    moved = apply_fix(spark, str(tmp_path), "a.py", 1, "GENERIC_SECRET")
    assert not moved.done and "any more" in moved.reason and not (tmp_path / ".env").exists()
    done = apply_fix(spark, str(tmp_path), "a.py", 2, "GENERIC_SECRET")
    assert len(done.done) == 4 and done.variable == "TOKEN"
    assert (tmp_path / "a.py").read_text() == 'import os\nfrom x import y\ntoken = os.environ["TOKEN"]\n'
    assert (tmp_path / ".env").read_text() == f"TOKEN={SECRET}\n" and (tmp_path / ".gitignore").read_text() == ".env\n"
    for path, line in (("../a.py", 1), ("a.py", 9), ("a.py", 3), ("none.py", 1)):
        assert not apply_fix(spark, str(tmp_path), path, line, "GENERIC_SECRET").done
    (tmp_path / "b.c").write_text(f'token = "{SECRET}"')
    assert "no safe rewrite" in apply_fix(spark, str(tmp_path), "b.c", 1, "GENERIC_SECRET").reason
    (tmp_path / ".env").write_text(f"token = '{SECRET}'")
    assert apply_fix(spark, str(tmp_path), ".env", 1, "GENERIC_SECRET").done == (".gitignore lists it",)


def test_stream(spark, tmp_path):
    from leakscan.streaming.findings import stream_findings

    lines = spark.createDataFrame([("a.py", None, i, f'token = "{SECRET}"', 1_700_000_000_000_000 + i) for i in range(3)], "file_path string, commit_hash string, line_number int, line_content string, seq bigint")
    lines.write.parquet(str(tmp_path / "in"))
    query = stream_findings(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("leaks").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("select * from leaks").collect()
    assert len(rows) == 1 and SECRET not in str(rows)
