from leakscan.plans import catalog


def test_leak_check_scans_once(spark):
    """Both sides of its join read the same computed findings."""
    out = catalog.QUERIES["leak_check"](spark, "/root/testdata/sf0.001")
    assert "FileScan" not in out._jdf.queryExecution().sparkPlan().toString()
    assert out.head().leaks == 0
