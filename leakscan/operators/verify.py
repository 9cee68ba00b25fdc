"""Opt-in verification of secrets by a callable that the caller supplies; there is none by default.

Each distinct secret is asked about once. A provider's secrets are dealt to as many lanes as it allows calls at a time; a lane is
never in two tasks, and a task goes through its lanes one call after the other, so the bound holds over the whole cluster. Answers
can be kept in a table by the hash of what was asked, and are not asked for again. A task that is repeated asks again for what it
had not finished.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import once, small
from ..functions.text import is_placeholder

Verifier = Callable[[str, str, str | None], bool | None]
ASKED = ["detector_type", "matched_string", "aws_secret"]


@dataclass(frozen=True)
class Throttle:
    """at_once: calls to a type's provider at a time, by type; others: of all other types; pause: least seconds between two
    calls of a lane; tries: calls for a secret whose answer is unknown or whose call fails; wait: seconds before the second
    call, doubled for each further one."""

    at_once: dict[str, int] = field(default_factory=dict)
    others: int = 4
    pause: float = 0.0
    tries: int = 3
    wait: float = 0.5

    def lanes(self, kind: Column) -> Column:
        out = F.lit(self.others)
        for name, n in self.at_once.items():
            out = F.when(kind == name, n).otherwise(out)
        return out


def with_aws_secret(found: DataFrame) -> DataFrame:
    """Adds aws_secret: the last AWS secret key found in the same file. found is computed once; the keys are broadcast if few."""
    found = once(found)
    last = found.where("detector_type = 'AWS_SECRET_KEY'").groupBy("file_path").agg(F.max_by("matched_string", F.struct("seq", "rank")).alias("aws_secret"))
    return found.join(small(last), "file_path", "left")


def question() -> Column:
    """What identifies a question in the table of answers, without the secret."""
    return F.sha2(F.concat_ws("\0", "detector_type", "matched_string", F.coalesce("aws_secret", F.lit(""))), 256)


def ask_all(asked: DataFrame, verifier: Verifier, throttle: Throttle) -> DataFrame:
    """asked (ASKED, distinct) with the answers, as `verified`."""
    lane = F.concat_ws("#", "detector_type", F.pmod(F.xxhash64("matched_string"), throttle.lanes(F.col("detector_type"))).cast("string"))
    tasks = sum(throttle.at_once.values()) + throttle.others
    dealt = asked.withColumn("lane", lane).repartition(tasks, "lane").sortWithinPartitions("lane")

    def answer(kind: str, secret: str, aws: str | None) -> bool | None:
        for n in range(throttle.tries):
            if n:
                time.sleep(throttle.wait * 2 ** (n - 1))
            try:
                verdict = verifier(kind, secret, aws)
            except Exception:  # noqa: BLE001  a provider that cannot be reached has given no answer
                verdict = None
            if verdict is not None:
                return verdict
        return None

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = 0.0
        for b in batches:
            verdicts = []
            for kind, secret, aws in b[ASKED].itertuples(index=False):
                time.sleep(max(0.0, begun + throttle.pause - time.monotonic()))
                begun = time.monotonic()
                verdicts.append(answer(kind, secret, None if aws is None or aws != aws else aws))
            yield b[ASKED].assign(verified=pd.Series(verdicts, dtype="object", index=b.index))

    return dealt.mapInPandas(ask, "detector_type string, matched_string string, aws_secret string, verified boolean")


def known_answers(asked: DataFrame, table: str | None) -> DataFrame:
    """question and verified of the table, which may not exist yet."""
    spark, schema = asked.sparkSession, "question string, verified boolean"
    if table is not None:
        try:
            return spark.read.schema(schema).parquet(table).groupBy("question").agg(F.max("verified").alias("verified"))
        except AnalysisException:
            pass  # the first run
    return spark.createDataFrame([], schema)


def verified(found: DataFrame, verifier: Verifier, throttle: Throttle = Throttle(), answers: str | None = None) -> DataFrame:
    """Adds verified (true, false, or null for unknown), asking once for each distinct type and secret that is no placeholder.
    answers: a table of earlier answers; new ones are appended, unknown ones are asked again the next time."""
    rows = with_aws_secret(found)
    # a file's secret key belongs to access keys only
    rows = rows.withColumn("aws_secret", F.when(F.col("detector_type") == "AWS_ACCESS_KEY", F.col("aws_secret")))
    asked = rows.where(~is_placeholder(F.col("matched_string"))).select(*ASKED).distinct().withColumn("question", question())
    known = known_answers(asked, answers)
    fresh = once(ask_all(asked.join(known, "question", "left_anti").select(*ASKED), verifier, throttle).withColumn("question", question()))
    both = known.join(asked.select("question"), "question", "left_semi").unionByName(fresh.select("question", "verified"))
    both = once(both) if answers is not None else both
    if answers is not None:
        fresh.where("verified is not null").select("question", "verified").write.mode("append").parquet(answers)
    return rows.withColumn("question", question()).join(both, "question", "left").drop("question", "aws_secret")
