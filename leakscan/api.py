"""Scans as DataFrames: lines of a target to ranked, redacted findings."""

from __future__ import annotations

import os
import shutil
import tempfile
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .functions.plan import once
from .functions.regexes import Signature, load_signatures
from .operators import dedup, detect, remediate, score, verify
from .sources.ignore import read_patterns, scan_patterns
from .sources.repo import ScanError, commit_stream, git, is_remote, repo_lines, resolve_target
from .streaming.findings import secret_states


@dataclass(frozen=True)
class ScanOptions:
    history: bool = False
    staged: bool = False
    max_commits: int | None = None
    ignore: tuple[str, ...] = ()
    ignore_file: str | None = None
    defaults: bool = True
    signatures: list[Signature] | None = None
    context: score.ScanContext = field(default_factory=score.ScanContext)
    entropy_threshold: float = detect.ENTROPY_THRESHOLD
    entropy_min_length: int = detect.MIN_LENGTH
    entropy_words: tuple[str, ...] = detect.CONTEXT_WORDS
    verifier: verify.Verifier | None = None


def target_lines(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Lines of a folder, with its history or only what is staged."""
    extra = list(options.ignore) + (read_patterns(options.ignore_file) if options.ignore_file else [])
    patterns = scan_patterns(root, extra, options.defaults)
    if options.staged:
        return repo_lines(spark, git(root, "rev-parse", "--show-toplevel", timeout=30).strip(), "staged", patterns)
    lines = repo_lines(spark, root, "tree", patterns)
    if options.history and os.path.exists(os.path.join(root, ".git")):
        lines = lines.unionByName(repo_lines(spark, root, "history", patterns, options.max_commits))
    return lines


def findings(lines: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Scored findings with remediation steps, of any lines (file_path, commit_hash, line_number, line_content, seq)."""
    found = dedup.line_findings(lines, signatures=options.signatures, threshold=options.entropy_threshold, min_length=options.entropy_min_length, words=options.entropy_words)
    found, context = dedup.collapse_commits(found), options.context
    if options.verifier is not None:
        found, context = verify.verified(found, options.verifier), replace(context, asked=True)
    return remediate.annotate(score.scored(found, context))


def scan(spark: SparkSession, target: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of a folder or a GitHub address, worst first. A clone lies in LEAKSCAN_CLONES (a folder that executors see; by
    default the session's shared one), and is removed once its findings are computed and kept."""
    if not is_remote(target):
        return score.worst_first(findings(target_lines(spark, resolve_target(target, ""), options), options))
    shared = spark.conf.get("spark.checkpoint.dir", "").removeprefix("file://")
    kept = os.environ.get("LEAKSCAN_CLONES") or (shared if os.path.isdir(shared) else None)
    if kept is None and not spark.sparkContext.master.startswith("local"):
        raise ScanError("set LEAKSCAN_CLONES to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="leakscan-", dir=kept)
    try:
        return score.worst_first(once(findings(target_lines(spark, resolve_target(target, os.path.join(folder, "clone")), options), options)))
    finally:
        shutil.rmtree(folder)


def watch(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """A stream (update mode) of the state of each path and secret in the commits of a repository, those there already and those
    to come; detection as scans without options of their own."""
    extra = list(options.ignore) + (read_patterns(options.ignore_file) if options.ignore_file else [])
    return secret_states(commit_stream(spark, root, scan_patterns(root, extra, options.defaults)))


__all__ = ["ScanOptions", "findings", "load_signatures", "scan", "target_lines", "watch"]
