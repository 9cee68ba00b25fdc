"""Planted histories as frames and as real repositories."""

import json
import re

from pyspark.sql import functions as F

from leakscan import api
from leakscan.plans import oracle
from leakscan.report import render
from leakscan.sources.planted import LEAKS, PlantRules, build_repository, planted_check, planted_files, planted_lines, repeated, secrets, top_points


def test_same_seed_same_history(spark):
    keys = spark.range(300).withColumnRenamed("id", "k")
    made = lambda df, **o: sorted(map(tuple, planted_files(df, PlantRules(**o)).collect()))
    assert made(keys) == made(keys.repartition(7)) != made(keys, seed=8)
    lines = planted_lines(planted_files(keys))
    assert lines.count() == lines.select("seq").distinct().count()
    assert planted_files(keys.limit(0)).count() == 0


def test_excluded_types_are_in_no_commit(spark):
    keys = spark.range(2000).withColumnRenamed("id", "k")
    for t, regex, _ in oracle.SIGNATURES:
        if t in ("STRIPE_KEY", "SLACK_TOKEN", "AWS_ACCESS_KEY"):
            hit = F.col("line_content").rlike(regex)
            assert planted_lines(planted_files(keys)).where(hit).count() > 0
            rules = PlantRules(exclude=(t,))
            assert planted_lines(planted_files(keys, rules), rules).where(hit).count() == 0


def test_a_real_repository_is_scanned_as_due(spark, tmp_path):
    files = planted_files(spark.range(90).withColumnRenamed("id", "k"))
    root = build_repository(files, str(tmp_path / "r"))
    found = api.scan(spark, root, api.ScanOptions(history=True, defaults=False))
    found.persist()
    rows = planted_check(files, found).collect()
    assert {r.outcome for r in rows} >= set(LEAKS) | {"ignored", "placeholder", "clean"}
    for r in rows:
        due = r.planted if r.outcome in LEAKS else 0
        assert (r.found_full, r.exposed, r.dated, r.others) == (due, due, due, 0), r
    assert repeated(found).count() == 0
    quick = {r.file_path for r in api.scan(spark, root, api.ScanOptions(history=True)).collect()}
    assert quick == {r.file_path for r in files.where(F.col("outcome").isin(*LEAKS) & (F.col("outcome") != "skipped")).collect()}
    lines = planted_lines(files).where("line_number = 2")
    secret = {r.v for r in files.where(F.col("outcome").isin(*LEAKS)).select(F.regexp_extract("content", "[A-Za-z0-9!_.-]{13,}", 0).alias("v")).collect()} - {""}
    assert lines.count() and secret
    for kind in ("terminal", "json", "html", "sarif"):
        assert not [s for s in secret if len(s) > 12 and not s.startswith(("aws_secret", "-----")) and s in render.report(found, kind)]


def test_points_follow_the_kind_of_file(spark):
    made = list(secrets(F.lit("0" * 32), F.lit("1" * 32)))
    assert made == sorted(made) and len(made) == 14
    found = spark.createDataFrame([(".env", "AWS_ACCESS_KEY", 65), (".env", "JWT", 70), ("tests/a.py", "AWS_ACCESS_KEY", 30), ("x", "JWT", 5)], "file_path string, detector_type string, points int")
    assert {tuple(r) for r in top_points(found, "AWS_ACCESS_KEY").collect()} == {(".env", 70, 65), ("tests/a.py", 30, 30), ("x", 5, None)}


def test_data_inside_a_page_cannot_end_its_script(spark):
    row = {"file_path": "a</script><b>&.py", "n": 1}
    text = render.script_json(row)
    assert json.loads(text) == row and not re.search("[<>&\u2028\u2029]", text)
