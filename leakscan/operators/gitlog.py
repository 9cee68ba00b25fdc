"""The log and diff parser as window functions over a table of raw log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMMIT = "^commit ([0-9a-f]{7,64})"
DIFF = "^diff --git a/.* b/(.*)$"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def parse_log(log: DataFrame) -> DataFrame:
    """Added lines of logs: log has (stream, n, raw), where a stream is one log and n orders its lines.

    Commit, file and hunk headers carry forward; a commit header forgets the file and a file header the hunk. Added, context
    and marker lines move the line number on, removed lines do not; lines that start with +++ count as headers. Every stream
    is one window partition, so logs are cut into streams of whole commits before they come here.
    """
    kinds = log.select("stream", "n", "raw", *[F.regexp_extract("raw", p, 1).alias(c) for p, c in ((COMMIT, "c"), (DIFF, "f"), (HUNK, "h"))])
    so_far = Window.partitionBy("stream").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = lambda *cols: F.sum(F.when(sum((F.col(x) != "").cast("int") for x in cols) > 0, 1).otherwise(0)).over(so_far)
    parts = kinds.withColumns({"cn": starts("c"), "fn": starts("c", "f"), "hn": starts("c", "f", "h")})
    carry = lambda c, *by: F.first(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(Window.partitionBy("stream", *by).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    header = (F.col("c") != "") | (F.col("f") != "") | (F.col("h") != "")
    moves = ~header & ~F.col("raw").startswith("-") & ~F.col("raw").startswith("+++")
    in_hunk = Window.partitionBy("stream", "hn").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = parts.withColumns({"commit_hash": F.substring(carry("c", "cn"), 1, 12), "file_path": carry("f", "fn"), "base": carry("h", "hn").cast("int"), "moved": F.sum(moves.cast("int")).over(in_hunk)})
    added = ~header & F.col("raw").startswith("+") & ~F.col("raw").startswith("+++") & F.col("file_path").isNotNull() & F.col("base").isNotNull()
    return state.where(added).select("stream", "n", "file_path", "commit_hash", (F.col("base") + F.col("moved") - 1).cast("int").alias("line_number"), F.expr("substring(raw, 2)").alias("line_content"))
