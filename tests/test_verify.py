"""Verification under limits, with a provider that writes down each call."""

import os
import time

from leakscan.operators.detect import raw_findings
from leakscan.operators.dedup import deduplicate
from leakscan.operators.verify import Throttle, verified
from leakscan.sources.ignore import GlobRules

KEYS = ["AKIA" + f"ABCDEFGH{i:08d}" for i in range(12)]
TOKENS = ["gh" + "p_" + f"{i:036d}" for i in range(9)]


def provider(folder):
    """A class of its own for each test, so that it travels to the workers by value."""

    class Calls:
        """Answers by the secret, and leaves a file for each call with its begin and end."""

        def __init__(self, folder):
            self.folder = str(folder)

        def __call__(self, kind, secret, aws):
            begun = time.monotonic()
            before = sum(f.startswith(f"{kind} {secret} ") for f in os.listdir(self.folder))
            time.sleep(0.15)
            with open(os.path.join(self.folder, f"{kind} {secret} {time.monotonic_ns()}"), "w") as f:
                f.write(f"{begun} {time.monotonic()}")
            if secret.endswith("3"):
                raise OSError("unreachable")
            if secret.endswith("5") and before < 1:
                return None  # known at the second call
            return secret.endswith("2")

        def made(self):
            out = {}
            for name in os.listdir(self.folder):
                kind, secret, _ = name.split(" ")
                with open(os.path.join(self.folder, name)) as f:
                    out.setdefault(kind, []).append((secret, *map(float, f.read().split())))
            return out

    return Calls(folder)


def found(spark):
    lines = [(f"f{i % 3}.txt", None, i, f"id {k}", i) for i, k in enumerate([*KEYS, *TOKENS, *KEYS])]
    return deduplicate(raw_findings(spark.createDataFrame(lines, "file_path string, commit_hash string, line_number int, line_content string, seq bigint")))


def test_calls_are_bounded_repeated_and_kept(spark, tmp_path):
    calls = provider(tmp_path / "calls")
    (tmp_path / "calls").mkdir()
    throttle = Throttle(at_once={"AWS_ACCESS_KEY": 2, "GITHUB_TOKEN": 1}, others=1, tries=2, wait=0.01)
    table = f"file://{tmp_path}/answers"
    got = {r.matched_string: r.verified for r in verified(found(spark), calls, throttle, table).collect()}
    want = {s: None if s.endswith("3") else s.endswith("2") for s in [*KEYS, *TOKENS]}
    assert got == want
    made = calls.made()
    for kind, most, secrets in (("AWS_ACCESS_KEY", 2, KEYS), ("GITHUB_TOKEN", 1, TOKENS)):
        times = made[kind]
        at_once = max(sum(b <= begun < e for _, b, e in times) for _, begun, _ in times)
        assert at_once <= most
        assert sorted(s for s, *_ in times) == sorted(s for s in secrets for _ in range(2 if s[-1] in "35" else 1))
    # known answers are not asked for again, unknown ones are
    again = {r.matched_string: r.verified for r in verified(found(spark), calls, throttle, table).collect()}
    assert again == want
    more = {s for kind in calls.made().values() for s, *_ in kind[0:]}
    counts = {s: sum(x[0] == s for kind in calls.made().values() for x in kind) for s in more}
    assert all(n == (4 if s.endswith("3") else 2 if s.endswith("5") else 1) for s, n in counts.items())
    assert not any(s in open(os.path.join(d, f), "rb").read().decode("latin-1") for d, _, names in os.walk(tmp_path / "answers") for f in names for s in KEYS)


def test_reduced_matcher(spark):
    from pyspark.sql import functions as F

    cases = [
        (["*.log"], "a/b.log", True), (["*.log", "!keep.log"], "keep.log", True), (["build/"], "a/build/x", True), (["build/"], "build", True), (["build/"], "rebuild/x", False), (["b*/"], "bin/x", True), (["b?n/"], "bin/x", False), (["src/*"], "src/a/b", True),
        (["f?o"], "a/fxo", True), (["[!a].c"], "b.c", True), (["[!a].c"], "a.c", False), (["[a"], "[a", True), (["a.b"], "axb", False), (["a\\b/"], "q", False), (["node_modules/"], "x\\node_modules\\y", True), ([""], "x", False), (["[]]"], "]", True), (["[a^]"], "^", True),
    ]
    for patterns, path, want in cases:
        rules = GlobRules(patterns)
        assert rules(path) is want, (patterns, path)
        assert spark.createDataFrame([(path,)], "p string").select(rules.column(F.col("p"))).first()[0] is want, (patterns, path)
