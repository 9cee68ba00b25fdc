"""A part of the registered queries against their SQL, and the entry module without its optional parts."""

import os
import subprocess
import sys

import duckdb
import pytest

from leakscan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
SOME = ["scan_lines_documents", "diff_parse_window", "ignore_filter", "binary_ratio", "entropy_detector", "dedup_across_commits", "filter_and_score", "baseline_anti_join", "sarif_rules", "rewrite_preview", "planted_history", "planted_found", "planted_excluded", "repeated_findings", "top_points", "ignore_reduced"]


def plain(rows):
    clean = lambda v: None if v is None else round(v, 9) if isinstance(v, float) else v
    return sorted(repr([clean(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({catalog.ORACLES[name]})").fetchall()
    assert plain(got.select(*cols).collect()) == plain(want)


def test_every_query_is_registered_with_its_sql():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert {f"detect_{s}" for s in ("jwt", "github_token")} <= set(catalog.QUERIES)


def test_entry_without_optional_parts(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "leakscan"):
        subprocess.run(["cp", "-r", os.path.join(root, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "leakscan" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 40 and "[]" in out.stdout
