"""Placeholder filter, points, severity, exposure, redaction and rationale of deduplicated findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import once, settled, small
from ..functions.text import file_class, is_placeholder, redact, redact_line

# Base points by type, and points by class of file.
BASE_POINTS = {
    "AWS_ACCESS_KEY": 50, "AWS_SECRET_KEY": 50, "PRIVATE_KEY_HEADER": 50, "DB_CONNECTION_STRING": 50, "STRIPE_KEY": 50, "GITHUB_TOKEN": 50, "GOOGLE_API_KEY": 50,
    "SLACK_TOKEN": 35, "SLACK_WEBHOOK": 35, "GENERIC_API_KEY": 35, "JWT": 35,
    "GENERIC_SECRET": 20, "GENERIC_PASSWORD": 20, "HIGH_ENTROPY": 20,
}
DEFAULT_POINTS = 25
CLASS_POINTS = {"env": (15, "in a .env file (+15)"), "config": (10, "in a config file (+10)"), "source": (5, "in source code (+5)"), "test": (-20, "in a test/example path (-20)"), "docs": (-25, "in docs/markdown (-25)")}
SEVERITIES = ("Low", "Medium", "High", "Critical")
BANDS = ((45, 4), (30, 3), (15, 2))


@dataclass(frozen=True)
class ScanContext:
    """keep_placeholders: cap instead of drop; min_severity: 1 (low) to 4 (critical); extra_placeholders: further expressions;
    asked: a verifier ran, so that findings without a verdict say so."""

    keep_placeholders: bool = False
    min_severity: int = 1
    extra_placeholders: tuple[str, ...] = ()
    asked: bool = False


def severity_number(name: str) -> int:
    labels = [s.lower() for s in SEVERITIES]
    if name.strip().lower() not in labels:
        raise ValueError(f"unknown severity {name!r}")
    return labels.index(name.strip().lower()) + 1


def severity_label(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), severity)


def base_points(kind: Column) -> Column:
    points = F.lit(DEFAULT_POINTS)
    for value in (50, 35, 20):
        points = F.when(kind.isin(*[k for k, v in BASE_POINTS.items() if v == value]), value).otherwise(points)
    return points.cast("int")


def severity_band(points: Column) -> Column:
    band = F.lit(1)
    for least, level in reversed(BANDS):
        band = F.when(points >= least, level).otherwise(band)
    return band.cast("int")


def number(score: Column) -> Column:
    """A score of two decimals as text, without trailing zeros but at least one decimal."""
    return F.regexp_replace(F.format_string("%.2f", score), r"(\.\d)0$", "$1")


def scored(found: DataFrame, context: ScanContext = ScanContext()) -> DataFrame:
    """found: deduplicated findings, maybe with a nullable boolean `verified`. The plain secret and line are left out. Findings that
    come without their line get no redacted_context."""
    if "verified" not in found.columns:
        found = found.withColumn("verified", F.lit(None).cast("boolean"))
    found = settled(found.withColumns({
        "placeholder": is_placeholder(F.col("matched_string"), context.extra_placeholders), "file_class": file_class(F.col("file_path")), "base": base_points(F.col("detector_type")), "redacted": redact(F.col("matched_string")),
    }))
    if not context.keep_placeholders:
        found = found.where(~F.col("placeholder"))
    entropy, verified = F.col("entropy_score"), F.col("verified")
    history = F.coalesce("commit_hash", F.lit("")) != ""
    by_class = F.lit(0)
    class_reason = F.lit(None).cast("string")
    for name, (points, reason) in CLASS_POINTS.items():
        by_class = F.when(F.col("file_class") == name, points).otherwise(by_class)
        class_reason = F.when(F.col("file_class") == name, reason).otherwise(class_reason)
    sums = F.col("base") + by_class - F.when(history, 5).otherwise(0) + F.when(entropy >= 4.5, 10).when(entropy >= 4.0, 5).otherwise(0)
    sums = F.when(verified, sums + 25).when(~verified, F.least(sums, F.lit(10))).otherwise(sums)
    sums = F.when(F.col("placeholder"), F.least(sums, F.lit(10))).otherwise(sums).cast("int")
    # The clauses of a rationale, which other tools read.
    reasons = F.array_compact(F.array(
        F.concat("detector_type", F.lit(" pattern (base "), F.col("base").cast("string"), F.lit(")")),
        class_reason,
        F.when(history, "history-only, removed from working tree (-5)"),
        F.when(entropy >= 4.5, F.concat(F.lit("very high entropy "), number(entropy), F.lit(" (+10)"))).when(entropy >= 4.0, F.concat(F.lit("high entropy "), number(entropy), F.lit(" (+5)"))),
        F.when(verified, "confirmed live by the provider (+25)").when(~verified, "provider rejected this credential (capped)"),
        F.when(F.col("placeholder"), "looks like a placeholder (capped)"),
    ))
    found = found.withColumns({"points": sums, "exposure": F.when(history, "history_only").otherwise("working_tree"), "reasons": F.array_join(reasons, ", ")})
    found = settled(settled(found).withColumn("severity", severity_band(F.col("points"))))
    if context.min_severity > 1:
        found = found.where(F.col("severity") >= context.min_severity)
    commits = F.size("history_commits")
    where = F.when(
        history, F.concat(F.lit("only in git history (commit "), "commit_hash", F.lit(")"), F.when(commits > 1, F.concat(F.lit(", seen in "), commits.cast("string"), F.lit(" commits"))).otherwise("")),
    ).otherwise(F.concat(F.lit("still in the working tree"), F.when(commits > 0, F.concat(F.lit(" and committed to history (introduced in "), F.get("history_commits", F.lit(0)), F.lit(", "), commits.cast("string"), F.lit(" commit(s))"))).otherwise("")))
    verdict = F.when(verified, " Verified: the provider accepts it, so it is live.").when(~verified, " Verified: the provider rejects it, so it is dead.").otherwise(" Not verified: no check exists for this type, or it gave no answer." if context.asked else "")
    rationale = F.concat(severity_label(F.col("severity")), F.lit(" severity: "), "redacted", F.lit(" ("), "detector_type", F.lit("), "), where, F.lit(". Score "), F.col("points").cast("string"), F.lit(" from "), "reasons", F.lit("."), verdict)
    context_line = [redact_line(F.col("line_content"), F.col("matched_string"), F.col("redacted"), F.col("start_col"), F.col("end_col")).alias("redacted_context")] if "line_content" in found.columns else []
    return found.select(
        "detector_type", "file_path", "line_number", "severity", "points", "exposure", "commit_hash", "redacted", *context_line,
        rationale.alias("rationale"), "entropy_score", "file_class", "verified", "occurrences", "history_commits", "seq", "rank",
    )


def still_shown(shown: DataFrame, secrets: DataFrame) -> DataFrame:
    """Every pair of a shown finding (file_path, redacted, redacted_context) and a secret of its file (file_path, matched_string; each once,
    of more than 8 characters) that it redacts alike and still holds. Both are read more than once.

    Very many secrets of a file may look alike, so they are not compared with each other: a secret begins with the four characters
    that its mask shows, and where a context has these, its text there, as long as the mask (24 at most), is looked up among the beginnings
    of the file's secrets. What is found tells the lengths at which whole secrets are looked up."""
    context, mask = F.col("redacted_context"), F.col("redacted")
    start, n = F.substring(mask, 1, 4), F.length(mask)
    first = F.call_function("locate", start, context)
    again = F.call_function("locate", start, context, first + 1)
    every = F.filter(F.sequence(F.lit(1), F.length(context)), lambda i: F.substring(context, i, F.lit(4)) == start)
    # most contexts hold them once, in the mask
    places = F.when(first == 0, F.array().cast("array<int>")).when(again == 0, F.array(first)).otherwise(every)
    heads = F.array_distinct(F.filter(F.transform(places, lambda i: F.substring(context, i, n)), lambda h: F.length(h) == n))
    spot = F.xxhash64("file_path", "head")  # rows are sorted by it

    begun = secrets.select("file_path", F.substring("matched_string", 1, 24).alias("head"), F.length("matched_string").alias("n")).withColumn("spot", spot)
    begun = begun.groupBy("spot", "file_path", "head").agg(F.collect_set(F.when(F.col("n") <= 200, F.col("n"))).alias("lengths"))
    sought = shown.where(n > 8).select("file_path", "redacted", "redacted_context", F.explode(heads).alias("head")).withColumn("spot", spot)
    met = sought.join(begun, ["spot", "file_path", "head"])
    there = F.filter(F.sequence(F.lit(1), F.length(context)), lambda i: F.substring(context, i, n) == F.col("head"))
    texts = F.flatten(F.transform(there, lambda i: F.transform("lengths", lambda k: F.when(i + k - 1 <= F.length(context), F.substring(context, i, k)))))
    whole = once(met.select("file_path", "redacted", "redacted_context", F.explode(F.array_distinct(F.array_compact(texts))).alias("matched_string")))
    return small(whole).join(secrets.select("file_path", "matched_string"), ["file_path", "matched_string"])


def worst_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("severity"), F.desc("points"), "seq", "rank")


def severity_counts(found: DataFrame) -> DataFrame:
    """All four bands, with their numbers of findings."""
    bands = found.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(SEVERITIES)], "severity int, label string")
    return F.broadcast(bands).join(found.groupBy("severity").count(), "severity", "left").select("severity", "label", F.coalesce("count", F.lit(0)).alias("findings"))


def exit_code(found: DataFrame, threshold: str | None) -> int:
    """1 if a finding is at least as severe as the threshold."""
    if threshold is None or threshold.strip().lower() == "none":
        return 0
    return int(not found.where(F.col("severity") >= severity_number(threshold)).isEmpty())
