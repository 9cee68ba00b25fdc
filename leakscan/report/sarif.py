"""SARIF 2.1.0: rules and results as DataFrames, and the frame around the results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.regexes import default_signatures
from ..functions.text import slashes
from ..operators.score import severity_label
from .frame import Frame

TOOL, VERSION = "leakscan", "1.0.0"
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
# Level and score of each severity from 1 (low) to 4 (critical).
LEVELS = ("note", "warning", "error", "error")
SCORES = ("3.0", "5.0", "7.0", "9.0")


def _of(values: tuple[str, ...], severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), severity)


def uri(path: Column) -> Column:
    return F.regexp_replace(slashes(path), "^/+", "")


def catalogue(spark) -> DataFrame:
    rows = [(s.type, s.description) for s in default_signatures()] + [("HIGH_ENTROPY", "High-entropy string in a credential-shaped assignment")]
    return spark.createDataFrame(rows, "id string, description string")


def rules(found: DataFrame) -> DataFrame:
    """One row per known or found type. A type without findings, or with low ones only, is declared at the middle level."""
    worst = found.groupBy(F.col("detector_type").alias("id")).agg(F.max("severity").alias("worst"))
    severity = F.when(F.coalesce("worst", F.lit(1)) == 1, 2).otherwise(F.col("worst"))
    return catalogue(found.sparkSession).join(worst, "id", "full").select("id", F.coalesce("description", "id").alias("description"), _of(LEVELS, severity).alias("level"), _of(SCORES, severity).alias("security_severity"))


def results(found: DataFrame) -> DataFrame:
    where = uri(F.col("file_path"))
    return found.select(
        F.col("detector_type").alias("rule_id"), _of(LEVELS, F.col("severity")).alias("level"), "rationale", where.alias("uri"), F.greatest(F.lit(1), "line_number").alias("start_line"),
        F.sha2(F.concat_ws("|", where, "detector_type", "redacted"), 256).alias("secret_hash"), "points", severity_label(F.col("severity")).alias("severity"), "exposure", "file_class", "occurrences", "verified", "commit_hash",
        "seq", "rank", F.col("severity").alias("order"),
    )


def ordered(found: DataFrame) -> DataFrame:
    """The results, worst first."""
    return results(found).orderBy(F.desc("order"), F.desc("points"), "seq", "rank")


def item(r: Row) -> str:
    properties = {"points": r["points"], "severity": r["severity"], "exposure": r["exposure"], "fileClass": r["file_class"], "occurrences": r["occurrences"]}
    properties |= {"verifiedLive": r["verified"]} if r["verified"] is not None else {}
    properties |= {"commit": r["commit_hash"]} if r["commit_hash"] else {}
    return json.dumps({
        "ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["rationale"]},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": r["start_line"]}}}],
        "partialFingerprints": {"secretHash/v1": r["secret_hash"]}, "properties": properties,
    }, indent=2)


def frame(found: DataFrame) -> Frame:
    listed = [
        {
            "id": r["id"], "name": r["id"].title().replace("_", ""), "shortDescription": {"text": r["description"]}, "fullDescription": {"text": f"{r['description']}. Reported by {TOOL}."},
            "defaultConfiguration": {"level": r["level"]}, "properties": {"tags": ["security", "secret"], "security-severity": r["security_severity"]},
        }
        for r in rules(found).orderBy("id").collect()
    ]
    head = json.dumps({"$schema": SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": TOOL, "version": VERSION, "rules": listed}}, "results": []}]}, indent=2)
    cut = head.rindex("[]") + 1
    return Frame(head[:cut], head[cut:], ",", item, head[cut:], "\n")
