"""Findings of a stream of lines.

Lines are clustered inside their row, so detection needs no state. stream_findings() reports a (path, secret) pair once while the
watermark of its first report lasts. secret_states() keeps for each pair what collapse_commits() makes of all its hits:
its representative, how often and in which commits it occurred, and gives that anew whenever a batch adds hits. The state of a pair
has an entry for each of its commits. Pairs are dealt by a hash into buckets; a batch reads and writes only the buckets it holds hits of.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import batched
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import redact, slashes
from ..operators.dedup import ROW, Points, hit_order, line_findings
from ..operators.score import base_points, severity_band

FIELDS = "detector_type string, matched_string string, file_path string, line_number int, commit_hash string, line_content string, entropy_score double, start_col int, end_col int"
FOUND = FIELDS + ", occurrences int, history_commits array<string>, seq bigint, rank int"
ORDER = ("live", "points", "length", "by_seq", "by_rank")
FOUND_NAMES = [c.split()[0] for c in FIELDS.split(", ")]
NAMES = [*FOUND_NAMES, "seq", "rank", *ORDER]  # of a hit
BUCKETS = 1 << 14


def stream_findings(lines: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """lines: a stream of (file_path, commit_hash, line_number, line_content, seq), where seq is a time in microseconds. Gives new
    leaks with their redacted value, points of the type, and band."""
    found = line_findings(lines).withColumn("seen_at", F.timestamp_micros("seq"))
    once = found.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["file_path", "matched_string"])
    points = base_points(F.col("detector_type"))
    return once.select("seen_at", "file_path", "commit_hash", "line_number", "detector_type", redact(F.col("matched_string")).alias("redacted"), points.alias("points"), severity_band(points).alias("severity"))


def packed(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class SecretState(StatefulProcessor):
    """The running results of collapse_commits for the paths and secrets of a bucket, read and written whole once a batch: each access is
    a call from Python to the JVM, and what a key gives out is an Arrow batch of its own, so keys of one pair spend their time on those.
    The value is JSON, by pair: its top hit, the place of its first one, its first score, its hits and the last place in each commit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "pairs string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for out in self.merged(row.asDict() for row in rows):
            yield Row(**out)

    def merged(self, hits: Iterable[dict[str, Any]]) -> Iterator[dict[str, Any]]:
        """Adds hits to the state and gives the results of their pairs."""
        known = self.state.get()
        pairs, touched = json.loads(known[0]) if known else {}, set()
        for hit in hits:
            path = (hit.get("file_path") or "").replace("\\", "/")
            pair = f"{len(path)}:{path}{hit.get('matched_string')}"
            pairs[pair] = self.added(pairs.get(pair), hit)
            touched.add(pair)
        self.state.update((packed(pairs),))
        for p in map(pairs.get, touched):
            top, (seq, rank), score = p["top"], p["first"], p["scored"][2]
            history = sorted(p["commits"], key=lambda c: (p["commits"][c], c), reverse=True)
            out = {c: top.get(c) for c in FOUND_NAMES} | {"occurrences": p["hits"], "history_commits": history, "seq": seq, "rank": rank}
            yield out if out["entropy_score"] is not None else out | {"entropy_score": score}

    @staticmethod
    def added(pair: dict[str, Any] | None, hit: dict[str, Any], order: itemgetter = itemgetter(*ORDER)) -> dict[str, Any]:
        """The state of a pair with a hit more."""
        at, score, commit = [hit["seq"], hit["rank"]], hit.get("entropy_score"), hit.get("commit_hash")
        if pair is None:
            pair = {"top": hit, "first": at, "scored": [None, None, None], "hits": 0, "commits": {}}
        elif order(hit) > order(pair["top"]):
            pair["top"] = hit
        if score is not None and (pair["scored"][2] is None or at < pair["scored"][:2]):
            pair["scored"] = [*at, score]
        if commit:
            pair["commits"][commit] = max(at, pair["commits"].get(commit, at))
        pair["first"], pair["hits"] = min(at, pair["first"]), pair["hits"] + 1
        return pair

    def close(self) -> None:
        pass


class PackedStates(SecretState):
    """SecretState of hits in JSON, with the results of many pairs in one JSON text: Python fetches and gives values one by one."""

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for some in batched(self.merged(json.loads(hit) for _, hit in rows), 1000):
            yield Row(states=packed(some))


def secret_states(lines: DataFrame, points: Points = base_points, buckets: int = BUCKETS) -> DataFrame:
    """lines: a stream of (file_path, commit_hash, line_number, line_content, seq) as of sources.repo.commit_stream(). Gives, in
    update mode, the rows of collapse_commits() for the paths and secrets that a batch adds to; the last row of each is its state.
    buckets: into how many parts the states are dealt; fixed for a checkpoint."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if lines.sparkSession.conf.get(provider, None) != rocks:
        lines.sparkSession.conf.set(provider, rocks)  # the only one that keeps such states
    order = hit_order(points)
    parts = dict(zip(ORDER, "ablsr", strict=True))
    bucket = F.pmod(F.xxhash64(slashes(F.col("file_path")), "matched_string"), F.lit(buckets)).cast("int")
    found = line_findings(lines).select(bucket.alias("bucket"), *ROW, order.alias("o"))
    hit = F.to_json(F.struct(*ROW, *[F.col(f"o.{p}").cast("bigint").alias(c) for c, p in parts.items()]))
    kept = found.select("bucket", hit.alias("hit")).groupBy("bucket").transformWithState(statefulProcessor=PackedStates(), outputStructType="states string", outputMode="Update", timeMode="None")
    return kept.select(F.explode(F.from_json("states", f"array<struct<{FOUND}>>", {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)})).alias("state")).select("state.*")
