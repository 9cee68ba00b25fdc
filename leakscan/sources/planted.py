"""Histories with planted leaks: what a scan must find in them, what it must not, and the check of both.

Each integer key makes one file. A hash of seed and key decides what becomes of it, what it holds, where it lies and which commit
adds it, so a history is the same wherever and however often it is made, and grows with its keys.
"""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import settled
from ..functions.text import slashes
from .ignore import DEFAULT_IGNORES, IGNORE_NAME, ignored

#: What becomes of a file, by the first hex digit of its hash.
OUTCOMES = {"live": "0123", "deleted": "456", "uncommitted": "78", "skipped": "9a", "ignored": "b", "placeholder": "cd", "clean": "ef"}
#: Outcomes whose secret a scan of everything reports.
LEAKS = ("live", "deleted", "uncommitted", "skipped")
#: What the ignore file of such a history lists; scans of everything heed it too.
IGNORE_FILE = ("vendor/",)


@dataclass(frozen=True)
class PlantRules:
    """seed: of all choices; commits: of the history; exclude: detector types that are never written, in no commit."""

    seed: int = 7
    commits: int = 4
    exclude: tuple[str, ...] = ()


def secrets(m: Column, w: Column) -> dict[str, tuple[Column, Column, Column]]:
    """Of each detector type: the text before a secret, the secret, the text after it. m, w: 32 hex digits each. Prefixes are
    split, so that this file holds none of them."""
    a, b = (lambda n: F.substring(m, 1, n)), (lambda n: F.substring(w, 1, n))
    quoted = lambda name, value: (F.lit(f'{name} = "'), value, F.lit('"'))
    return {
        "AWS_ACCESS_KEY": (F.lit("id: "), F.concat(F.lit("AKIA"), F.upper(a(16))), F.lit("")),
        "AWS_SECRET_KEY": quoted("aws_secret_access_key", F.concat(m, b(8))),
        "DB_CONNECTION_STRING": (F.lit("url: "), F.concat(F.lit("postgres://app:"), a(10), F.lit("@db.internal.net")), F.lit("/main")),
        "GENERIC_API_KEY": quoted("api_key", a(24)),
        "GENERIC_PASSWORD": quoted("password", F.concat(F.lit("Pw!"), a(9))),
        "GENERIC_SECRET": quoted("token", a(16)),
        "GITHUB_TOKEN": (F.lit("use "), F.concat(F.lit("gh" + "p_"), m, b(4)), F.lit("")),
        "GOOGLE_API_KEY": (F.lit("maps "), F.concat(F.lit("AI" + "za"), m, b(3)), F.lit("")),
        "HIGH_ENTROPY": (F.lit("AUTH_TOKEN="), F.concat(a(12), F.lit("QxZvKpWmRtYs")), F.lit("")),
        "JWT": (F.lit("bearer "), F.concat(F.lit("ey" + "J"), a(20), F.lit("."), b(20), F.lit("."), F.substring(m, 5, 20)), F.lit("")),
        "PRIVATE_KEY_HEADER": (F.lit(""), F.lit("-----BEGIN RSA " + "PRIVATE KEY-----"), F.lit("")),
        "SLACK_TOKEN": (F.lit("slack "), F.concat(F.lit("xo" + "xb-"), a(24)), F.lit("")),
        "SLACK_WEBHOOK": (F.lit('post("'), F.concat(F.lit("https://hooks.slack" + ".com/services/T"), F.upper(a(9)), F.lit("/B"), F.upper(b(9)), F.lit("/"), F.substring(m, 9, 24)), F.lit('")')),
        "STRIPE_KEY": (F.lit("charge("), F.concat(F.lit("sk_" + "live_"), a(24)), F.lit(")")),
    }


def planted_files(keys: DataFrame, rules: PlantRules = PlantRules()) -> DataFrame:
    """keys (k, distinct integers) as files: k, file_path, outcome, detector_type ('-' for what holds no secret), content (its
    one telling line), step (the commit that adds it, from 0). An excluded type leaves a clean file in its place."""
    rows = keys.select(F.col("k").cast("long").alias("k"))
    salted = lambda salt: F.md5(F.concat(F.lit(f"{rules.seed}{salt}"), F.col("k").cast("string")))
    rows = settled(rows.withColumns({"m": salted(":"), "w": salted("/")}))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring("m", i, 1)) - 1
    made = secrets(F.col("m"), F.col("w"))
    outcome = F.lit("clean")
    for name, digits in OUTCOMES.items():
        outcome = F.when(F.substring("m", 1, 1).isin(list(digits)), name).otherwise(outcome)
    kind = F.element_at(F.array(*[F.lit(t) for t in made]), ((digit(2) * 16 + digit(3)) % len(made) + 1).cast("int"))
    rows = rows.withColumns({"drawn": kind, "outcome": outcome})
    gone = F.col("drawn").isin(list(rules.exclude)) if rules.exclude else F.lit(False)
    rows = rows.withColumn("outcome", F.when(gone & F.col("outcome").isin("ignored", *LEAKS), "clean").otherwise(F.col("outcome")))
    line = F.lit('region = lookup("zone")')
    for t, parts in made.items():
        line = F.when(F.col("drawn") == t, F.concat(*parts)).otherwise(line)
    k = F.col("k").cast("string")
    folder = F.when(F.col("outcome") == "skipped", "node_modules/leaky/").when(F.col("outcome") == "ignored", "vendor/").otherwise("")
    place = F.element_at(F.array(
        F.concat(F.lit("deploy/"), k, F.lit("/.env")), F.concat(F.lit("config/c"), k, F.lit(".yml")), F.concat(F.lit("src/m"), k, F.lit(".py")),
        F.concat(F.lit("tests/test_"), k, F.lit(".py")), F.concat(F.lit("docs/p"), k, F.lit(".md")),
    ), (digit(4) % 5 + 1).cast("int"))
    silent = F.col("outcome").isin("placeholder", "clean")
    # a file is made once, not again by every filter on its path
    return settled(rows.select(
        "k", F.concat(folder, place).alias("file_path"), "outcome", F.when(silent, "-").otherwise(F.col("drawn")).alias("detector_type"),
        F.when(F.col("outcome") == "placeholder", 'secret = "your_api_key_here"').when(silent, F.lit('region = lookup("zone")')).otherwise(line).alias("content"),
        (digit(5) % rules.commits).cast("int").alias("step"),
    ))


def planted_lines(files: DataFrame, rules: PlantRules = PlantRules()) -> DataFrame:
    """The lines that a scan of the tree and of the whole history reads: those of the working tree without a commit."""
    commit = F.substring(F.md5(F.concat(F.lit(f"{rules.seed}commit"), F.col("step").cast("string"))), 1, 12)
    tree = F.when(F.col("outcome") != "deleted", F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    history = F.when(F.col("outcome") != "uncommitted", F.array(commit)).otherwise(F.array().cast("array<string>"))
    rows = files.select("k", "file_path", F.explode(F.concat(tree, history)).alias("commit_hash"), F.array(F.lit("# made from a seed"), "content").alias("lines"))
    rows = rows.select("k", "file_path", "commit_hash", F.posexplode("lines").alias("n", "line_content"))
    seq = F.col("k") * 4 + F.when(F.col("commit_hash").isNull(), 0).otherwise(2) + F.col("n")
    return rows.select("file_path", "commit_hash", (F.col("n") + 1).alias("line_number"), "line_content", seq.alias("seq"))


def heeded(lines: DataFrame) -> DataFrame:
    """The lines without those of files that the ignore file lists."""
    return lines.where(~ignored(F.col("file_path"), list(IGNORE_FILE)))


def planted_check(files: DataFrame, found: DataFrame) -> DataFrame:
    """Of each outcome and type: planted files, those of which a scan of everything and one with the default ignore rules found
    that type (found_full, found_quick), those with the exposure that is due (exposed) and with commits exactly if they were committed
    (dated), and findings of any other type (others). found: scored findings of heeded lines.

    Findings are counted by path ahead of the join, and a path is one file, so no key is hot whatever holds most findings."""
    skipped = ignored(F.col("file_path"), DEFAULT_IGNORES)
    per = found.groupBy(slashes(F.col("file_path")).alias("file_path"), "detector_type").agg(F.count(F.lit(1)).alias("n"), F.min("exposure").alias("exposure"), F.min(F.size("history_commits")).alias("commits"))
    per = per.groupBy("file_path").agg(F.collect_list(F.struct("detector_type", "n", "exposure", "commits")).alias("hits"))  # a path has a type once
    rows = files.join(per, "file_path", "left")
    own = F.get(F.filter("hits", lambda h: h["detector_type"] == F.col("detector_type")), F.lit(0))
    total = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["n"]), F.lit(0))
    rows = rows.select("outcome", "detector_type", skipped.alias("skipped"), own.alias("own"), total.alias("total"))
    due = F.when(F.col("outcome") == "deleted", "history_only").otherwise("working_tree")
    hit = F.col("own").isNotNull()
    return rows.groupBy("outcome", "detector_type").agg(
        F.count(F.lit(1)).alias("planted"), F.count_if(hit).alias("found_full"), F.count_if(hit & ~F.col("skipped")).alias("found_quick"), F.count_if(F.col("own.exposure") == due).alias("exposed"),
        F.count_if((F.col("own.commits") > 0) == (F.col("outcome") != "uncommitted")).alias("dated"), F.sum(F.col("total") - F.when(hit, 1).otherwise(0)).alias("others"),
    )


def repeated(found: DataFrame) -> DataFrame:
    """Paths that show the same redacted secret more than once, with the number of its findings. Different secrets may look alike
    when redacted; of planted ones none do that."""
    return found.groupBy(slashes(F.col("file_path")).alias("file_path"), "redacted").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def top_points(found: DataFrame, *types: str) -> DataFrame:
    """For each path its highest points, and those of its findings of each named type (null without one)."""
    each = [F.max(F.when(F.col("detector_type") == t, F.col("points"))).alias(t.lower()) for t in types]
    return found.groupBy(slashes(F.col("file_path")).alias("file_path")).agg(F.max("points").alias("points"), *each)


def build_repository(files: DataFrame, root: str, rules: PlantRules = PlantRules()) -> str:
    """Writes the files as a git repository in a new folder, a row at a time, for tests and demonstrations: one commit a step,
    deleted files go in a last one, uncommitted ones are left in the working tree, with a binary file beside them."""

    def git(*args: str) -> None:
        subprocess.run(["git", "-C", root, "-c", "user.name=planted", "-c", "user.email=planted@localhost", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)

    def put(path: str, content: bytes) -> None:
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "wb") as f:
            f.write(content)

    os.makedirs(root)  # an existing folder is never written over
    git("init", "-q")
    put(IGNORE_NAME, "".join(f"{p}\n" for p in IGNORE_FILE).encode())
    step, gone = 0, []

    def commit_until(end: int) -> None:
        nonlocal step
        for step in range(step, end):
            git("add", "-A", "-f")
            git("commit", "-q", "--allow-empty", "-m", f"step {step}")
        step = max(step, end)

    last = F.when(F.col("outcome") == "uncommitted", rules.commits).otherwise(F.col("step"))
    for r in files.withColumn("step", last).orderBy("step", "k").toLocalIterator():
        commit_until(r.step)
        put(r.file_path, f"# made from a seed\n{r.content}\n".encode())
        if r.outcome == "deleted":
            gone.append(r.file_path)
    commit_until(rules.commits)
    for path in gone:
        git("rm", "-q", "--", path)
    git("commit", "-q", "--allow-empty", "-m", "clean up")
    put("assets/logo.bin", b"\x89PNG\0" + b"token = \"" + b"q7Zk2mV9pL4wT8rB" + b"\"\0")
    return root
