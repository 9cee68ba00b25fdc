"""Command line: python -m leakscan TARGET. Ends with 0, 1 (a finding at or above --fail-on) or 2 (bad use)."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .api import ScanOptions, load_signatures, scan
from .functions.regexes import PatternError
from .operators import baseline
from .operators.providers import verifier
from .operators.score import ScanContext, exit_code, severity_number
from .report.render import report
from .sources.repo import ScanError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("leakscan", description="Finds leaked credentials in a folder or repository.")
    p.add_argument("target")
    p.add_argument("--history", action="store_true")
    p.add_argument("--staged", action="store_true")
    p.add_argument("--max-commits", type=int)
    p.add_argument("--full", action="store_true", help="no default ignore rules")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--ignore-file")
    p.add_argument("--patterns")
    p.add_argument("--format", default="terminal")
    p.add_argument("--output")
    p.add_argument("--min-severity", default="low")
    p.add_argument("--fail-on", default="none")
    p.add_argument("--keep-placeholders", action="store_true")
    p.add_argument("--verify-live", action="store_true", help="ask the providers whether secrets are live")
    p.add_argument("--baseline")
    p.add_argument("--no-baseline", action="store_true")
    p.add_argument("--update-baseline", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.history and args.staged:
        print("--history and --staged exclude each other", file=sys.stderr)
        return 2
    try:
        context = ScanContext(keep_placeholders=args.keep_placeholders, min_severity=severity_number(args.min_severity))
        options = ScanOptions(args.history, args.staged, args.max_commits, tuple(args.ignore), args.ignore_file, not args.full, load_signatures(args.patterns) if args.patterns else None, context, verifier=verifier() if args.verify_live else None)
        spark = spark or SparkSession.builder.appName("leakscan").getOrCreate()
        found = scan(spark, args.target, options).cache()
        path = args.baseline or (os.path.join(args.target, baseline.BASELINE_NAME) if os.path.isdir(args.target) else None)
        if args.update_baseline:
            if path is None:
                raise ScanError("a remote target needs --baseline")
            print(f"{baseline.save(path, found)} finding(s) accepted in {path}")
            return 0
        hidden = 0
        if path and not args.no_baseline:
            found, gone = baseline.suppress(found, baseline.load(spark, path))
            hidden = gone.count()
        text = report(found, args.format, args.output, color=args.output is None and sys.stdout.isatty())
        if not args.output:
            print(text)
        if hidden:
            print(f"{hidden} finding(s) suppressed by the baseline", file=sys.stderr)
        return exit_code(found, args.fail_on)
    except (ScanError, PatternError, ValueError, OSError) as e:
        print(f"leakscan: {e}", file=sys.stderr)
        return 2
