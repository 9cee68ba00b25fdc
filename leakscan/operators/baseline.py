"""Accepted findings: fingerprints, suppression, the baseline file, and the baseline as a table.

A baseline file is read and written on the driver, for the size of one repository. A table (Parquet, keyed by fingerprint) has no
such bound: findings are merged into it by an anti-join, and suppressed by it in two steps. A Bloom filter of the accepted
fingerprints, 16 bits for each, is built by aggregation into bitmaps of 4 KB and broadcast; findings that it does not know are new
and take no part in a join, so only the others (with about one new one in 16) are shuffled.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import once
from ..functions.text import slashes
from .score import severity_label

BASELINE_NAME = ".leakbaseline"
HEADER = "# Accepted findings; their fingerprints are not reported.\n# <sha256>  # <file>:<line> <TYPE> <Severity>\n"


def fingerprint() -> Column:
    """Stable identity of a finding: path, type and mask, but not the line number."""
    return F.sha2(F.concat_ws("\0", slashes(F.col("file_path")), F.col("detector_type"), F.col("redacted")), 256)


BITMAP = 32768  # bits of one bitmap, as Spark's bitmap functions have it
MOST_BITMAPS = 50_000  # 200 MB, the filter of 10^8 fingerprints; with more all findings are joined


def bloom_filter(accepted: DataFrame, rows: int, bits: int = 16) -> tuple[DataFrame, Column] | None:
    """The filter of a column fingerprint as a table (bucket, bitmap) and the place of a fingerprint in it; None if too large."""
    buckets = -(-rows * bits // BITMAP)
    if buckets > MOST_BITMAPS:
        return None
    place = F.pmod(F.xxhash64("fingerprint"), F.lit(buckets * BITMAP))
    bucket, bit = F.floor(place / BITMAP).cast("int"), (place % BITMAP).cast("long")
    table = accepted.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    return table, place


def may_hold(found: DataFrame, accepted: DataFrame, rows: int) -> DataFrame:
    """found (with a fingerprint), and in may_hold whether the filter of accepted knows it."""
    made = bloom_filter(accepted, rows)
    if made is None:
        return found.withColumn("may_hold", F.lit(True))
    table, place = made
    byte = F.conv(F.hex(F.substring("bitmap", F.floor((F.col("place") % BITMAP) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1, F.lit(False))
    placed = found.withColumn("place", place).withColumn("bucket", F.floor(F.col("place") / BITMAP).cast("int"))
    return placed.join(F.broadcast(table), "bucket", "left").withColumn("may_hold", known).drop("bucket", "place", "bitmap")


def suppress(found: DataFrame, accepted: DataFrame, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Findings that are not accepted, and those that are; accepted: a column fingerprint. Few fingerprints are broadcast."""
    accepted = accepted.select("fingerprint").distinct()
    marked = found.withColumn("fingerprint", fingerprint())
    if accepted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        accepted = F.broadcast(accepted)
        return marked.join(accepted, "fingerprint", "left_anti").drop("fingerprint"), marked.join(accepted, "fingerprint", "left_semi").drop("fingerprint")
    marked = may_hold(marked, accepted, accepted.count())
    maybe = marked.where("may_hold")
    fresh = marked.where("not may_hold").unionByName(maybe.join(accepted, "fingerprint", "left_anti").select(marked.columns))
    return fresh.drop("fingerprint", "may_hold"), maybe.join(accepted, "fingerprint", "left_semi").drop("fingerprint", "may_hold")


def accepted_table(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a baseline table; none if it does not exist yet."""
    schema = "fingerprint string, file_path string, line_number int, detector_type string, severity int"
    try:
        return spark.read.schema(schema).parquet(table)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def merge(found: DataFrame, table: str, broadcast_rows: int = 200_000) -> int:
    """Adds the findings that a baseline table does not have yet, one for each fingerprint, and says how many these were. Nothing
    passes through the driver."""
    known = accepted_table(found.sparkSession, table)
    fresh = suppress(once(found), known, broadcast_rows)[0].withColumn("fingerprint", fingerprint())
    first = fresh.groupBy("fingerprint").agg(F.min_by(F.struct(slashes(F.col("file_path")).alias("file_path"), "line_number", "detector_type", "severity"), F.struct("seq", "rank")).alias("f"))
    rows = once(first.select("fingerprint", "f.*"))
    rows.write.mode("append").parquet(table)
    return rows.count()


def load(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of a baseline file on the driver's disk; none if there is no file."""
    try:
        with open(path, encoding="utf-8") as f:
            rows = sorted({s for line in f if (s := line.split("#")[0].strip())})
    except FileNotFoundError:
        rows = []
    return spark.createDataFrame([(r,) for r in rows], "fingerprint string")


def lines(found: DataFrame) -> DataFrame:
    """Lines of a baseline file, in order."""
    path = slashes(F.col("file_path"))
    line = F.concat(fingerprint(), F.lit("  # "), path, F.lit(":"), F.col("line_number").cast("string"), F.lit(" "), "detector_type", F.lit(" "), severity_label(F.col("severity")))
    return found.select(path.alias("p"), "detector_type", "seq", "rank", line.alias("line")).orderBy("p", "detector_type", "seq", "rank").select("line")


def save(path: str, found: DataFrame) -> int:
    """Replaces the baseline with the findings at hand; rows stream through the driver one by one."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(HEADER)
        for row in lines(found).toLocalIterator():
            f.write(row["line"] + "\n")
            n += 1
    return n
