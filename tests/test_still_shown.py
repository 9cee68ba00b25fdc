"""Shown lines that still hold a secret, of files with many secrets that look alike."""

import random
import time

from pyspark.sql import functions as F

from leakscan.functions.text import redact
from leakscan.operators import score


def plain(shown, secrets):
    """The same by comparing each shown line with each secret of its file and mask."""
    own = secrets.withColumn("redacted", redact(F.col("matched_string")))
    return shown.join(own, ["file_path", "redacted"]).where(F.contains("redacted_context", "matched_string"))


def test_equals_comparing_all(spark):
    r = random.Random(3)
    word = lambda least: "".join(r.choice("aé*") for _ in range(r.randrange(least, 34)))
    secrets = sorted({(r.choice("xy"), "aaaa"[: r.randrange(3, 5)] + word(6)) for _ in range(120)})
    own = spark.createDataFrame(secrets, "file_path string, matched_string string")
    near = lambda s: "".join(r.choice([s, s[:-1], s[1:], "*", word(0), "aaaa"]) for _ in range(r.randrange(4)))[:200]
    lines = [(p, r.choice(secrets)[1], near(s)) for p, s in secrets for _ in range(20)] + [(None, "a" * 12, "a" * 30), ("x", "a" * 12, ""), ("x", "aaaa", "aaaaaaaaaaaa")]
    shown = spark.createDataFrame(lines, "file_path string, secret string, redacted_context string").withColumn("redacted", redact(F.col("secret"))).drop("secret")
    rows = lambda df: sorted(map(tuple, df.select("file_path", "redacted", "redacted_context", "matched_string").collect()))
    want = rows(plain(shown, own))
    assert len(want) > 50 and any(len(x[3]) > 24 for x in want) and rows(score.still_shown(shown, own)) == want


def test_time_grows_with_the_lines(spark):
    """100,000 secrets of one file with one mask: 10 billion pairs, of which one is a leak, shown twice in its line."""
    key = lambda i: F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(F.col(i).cast("string")), 1, 16)))
    own = spark.range(100_000).select(F.lit("Makefile").alias("file_path"), key("id").alias("matched_string"))
    text = F.concat(F.lit("key_id = AKIA****************"), F.when(F.col("id") == 7, F.concat(F.lit(" AKIA "), key("id"), key("id"))).otherwise(""))
    shown = spark.range(100_000).select(F.lit("Makefile").alias("file_path"), F.lit("AKIA****************").alias("redacted"), text.alias("redacted_context"))
    begin = time.perf_counter()
    assert score.still_shown(shown, own).count() == 1
    assert time.perf_counter() - begin < 60
