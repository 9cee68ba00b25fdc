"""Reports that executors write."""

import json
import os

import pytest

from leakscan.api import ScanOptions, findings
from leakscan.report.render import report
from leakscan.report.sink import Part, ReportWriter, write_report

SECRET = "Zx9" + "kQ2mV7pL4wT8r"


def found(spark, n):
    lines = [(f"src/f{i % 7}.py", None if i % 3 else f"c{i:011d}", i + 1, f'token = "{SECRET}{i:03d}" # </script>', i) for i in range(n)]
    df = spark.createDataFrame(lines, "file_path string, commit_hash string, line_number int, line_content string, seq bigint")
    return spark.createDataFrame((f := findings(df, ScanOptions())).collect(), f.schema)


@pytest.mark.parametrize("kind", ["json", "sarif", "html"])
def test_report_of_executors_is_that_of_the_driver(spark, tmp_path, kind):
    for n in (60, 1, 0):
        rows, path = found(spark, n).repartition(5), str(tmp_path / f"{kind}{n}")
        write_report(rows, kind, path)
        with open(path, encoding="utf-8") as f:
            text = f.read()
        assert text == report(rows, kind) and SECRET not in text
        if kind != "html":
            held = json.loads(text)
            assert len(held if kind == "json" else held["runs"][0]["results"]) == n
    assert sorted(os.listdir(tmp_path)) == sorted(f"{kind}{n}" for n in (60, 1, 0))
    with pytest.raises(ValueError):
        write_report(found(spark, 1), "terminal", str(tmp_path / "t"))


def test_lost_parts_are_not_joined(tmp_path):
    path = str(tmp_path / "r.json")
    writer = ReportWriter({"path": path, "kind": "json", "run": "1", "head": "[", "tail": "]", "none": "]", "between": ",", "lead": ""})
    os.makedirs(writer.folder)
    for name, text in (("1-8", "2"), ("0-7", "1"), ("1-5", "broken"), ("2-9", "")):
        with open(os.path.join(writer.folder, name), "w") as f:
            f.write(text)
    part = lambda p, name, n: Part(p, os.path.join(writer.folder, name), n)
    writer.commit([part(1, "1-8", 1), part(2, "2-9", 0), None, part(0, "0-7", 1)])
    with open(path) as f:
        assert f.read() == "[1,2]"
    os.makedirs(writer.folder)
    writer.abort([])
    assert os.listdir(tmp_path) == ["r.json"]
