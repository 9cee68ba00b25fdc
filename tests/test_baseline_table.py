"""The baseline as a table: merges by fingerprint, and suppression behind the Bloom filter."""

from pyspark.sql import functions as F

from leakscan.operators import baseline


def findings(spark, names, seq=0):
    rows = [(f"f{n}.py", n + 1, "JWT", "eyJ***", 3, seq + n, 0) for n in names]
    return spark.createDataFrame(rows, "file_path string, line_number int, detector_type string, redacted string, severity int, seq bigint, rank int")


def test_merge_adds_each_fingerprint_once(spark, tmp_path):
    table = f"file://{tmp_path}/baseline"
    assert baseline.accepted_table(spark, table).count() == 0
    for limit in (200_000, 0):  # by broadcast, and behind the filter
        table = f"file://{tmp_path}/baseline{limit}"
        assert baseline.merge(findings(spark, [1, 2, 2, 3]), table, limit) == 3
        assert baseline.merge(findings(spark, [2, 3, 4], 100), table, limit) == 1
        assert baseline.merge(findings(spark, [1, 4]), table, limit) == 0
        held = baseline.accepted_table(spark, table)
        assert sorted(r.file_path for r in held.collect()) == ["f1.py", "f2.py", "f3.py", "f4.py"]


def test_suppression_behind_the_filter(spark):
    rows = findings(spark, range(3000))
    accepted = rows.where("line_number % 3 = 0").select(baseline.fingerprint().alias("fingerprint"))
    fresh, held = baseline.suppress(rows, accepted, broadcast_rows=0)
    assert fresh.columns == held.columns == rows.columns
    assert sorted(r.line_number for r in held.collect()) == [n for n in range(1, 3001) if n % 3 == 0]
    assert sorted(r.line_number for r in fresh.collect()) == [n for n in range(1, 3001) if n % 3]
    # no accepted one is missed, and about one new one in 16 passes the filter
    marked = baseline.may_hold(rows.withColumn("fingerprint", baseline.fingerprint()), accepted, 1000)
    passed = {r.line_number for r in marked.where("may_hold").collect()}
    assert {n for n in range(1, 3001) if n % 3 == 0} <= passed and len(passed) < 1000 + 2000 // 8
    assert baseline.suppress(rows, accepted.limit(0), broadcast_rows=0)[0].count() == 3000


def test_large_filters_are_left_out(spark):
    rows = findings(spark, [1]).withColumn("fingerprint", F.lit("x"))
    assert baseline.bloom_filter(rows, 10**9) is None and baseline.may_hold(rows, rows, 10**9).first().may_hold
    assert baseline.bloom_filter(rows, 10**7)[0].count() == 1
