"""Lines of a repository as a Python data source: `spark.read.format("repo_lines")`, and `readStream` for its new commits.

Options: path; mode; patterns (a JSON list of ignore rules); max_commits; batch, batch_bytes (most units and bytes of a task);
split_bytes (of a slice of a large file). Modes: tree, history, staged; slices and slice_counts are the parts of large files, which
repo_lines() puts together. Files and commits are listed on the driver, pruned there, and read in batches on the executors, so the
path must be one that all of them see. Spark's own file readers would leave out files whose names start with a dot, .env first of
all.

Filters on file_path and commit_hash are pushed into the listing (pushFilters), so what they rule out makes no task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith,
)

from . import history
from .history import HASH, PER_UNIT, ScanError, added_lines, git, git_lines
from .ignore import IgnoreRules

SCHEMA = "file_path string, commit_hash string, line_number int, line_content string, seq bigint"
SNIFF = 8192  # fixed value: bytes that decide whether a file is binary
TEXT_BYTES = bytes({7, 8, 9, 10, 12, 13, 27} | set(range(0x20, 0x100)) - {0x7F})
HISTORY = 1 << 60  # the history comes after the tree
STREAMED = 1 << 28  # a stream's commits count down from here, so that newer ones come first
SPLIT = 128_000_000


def is_binary(head: bytes) -> bool:
    """A null byte, or over 30 percent of bytes that texts do not have, among the first ones."""
    head = head[:SNIFF]
    return b"\0" in head or len(head.translate(None, TEXT_BYTES)) * 10 > 3 * len(head)


def binary_head(head: Column) -> Column:
    """is_binary for a column of first bytes, without Python: bytes become the characters of the same numbers."""
    chars = F.decode(F.substring(head, 1, SNIFF), "ISO-8859-1")
    odd = F.length(F.regexp_replace(chars, r"[\x07-\x0A\x0C\x0D\x1B\x20-\x7E\x{80}-\x{FF}]+", ""))
    return F.contains(chars, F.lit("\0")) | (odd * 10 > 3 * F.length(chars))


def tree_files(root: str, patterns: list[str]) -> list[str]:
    """Relative paths of the files to scan, in order."""
    rules, out = IgnoreRules(patterns), []
    for folder, folders, names in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if at == "." else at + "/"
        folders[:] = sorted(d for d in folders if not rules.prunes(prefix + d))
        out += [prefix + n for n in names if not rules(prefix + n)]
    return sorted(out)


def file_size(root: str, path: str) -> int:
    try:
        return os.path.getsize(os.path.join(root, path))
    except OSError:
        return 0


def file_lines(root: str, path: str, start: int = 0, end: int | None = None, piece: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """Lines that start in the bytes from start to end, numbered from 1 in that range: a line that begins inside is read to
    its end, one that began before is left to the range before. Pieces of the file are held, and one line."""
    try:
        with open(os.path.join(root, path), "rb") as f:
            if is_binary(f.read(SNIFF)):
                return
            at = start
            if start:
                f.seek(start - 1)
                two = f.read(2)
                whole = two[:1] == b"\n" or (two[:1] == b"\r" and two[1:] != b"\n")
                f.seek(start)
                # the line that reaches into this range ends first
                while not whole:
                    chunk = f.read(piece)
                    m = re.search(rb"\r\n|\r|\n", chunk)
                    if not chunk:
                        return
                    if m is None:
                        at += len(chunk)
                    else:
                        at += m.end()
                        if m[0] == b"\r" and m.end() == len(chunk):
                            f.seek(at)
                            at += f.read(1) == b"\n"
                        whole = True
                if end is not None and at >= end:
                    return
            f.seek(at)
            begun: list[bytes] = []  # pieces of the line that has no end yet
            number, skip = 0, False
            while chunk := f.read(piece):
                if skip and chunk[:1] == b"\n":  # the second half of a line end that two pieces share
                    chunk, at = chunk[1:], at + 1
                skip = chunk[-1:] == b"\r"
                first, *lines = re.split(rb"\r\n|\r|\n", chunk)
                begun.append(first)
                if not lines:
                    continue
                sizes = [len(x) for x in re.findall(rb"\r\n|\r|\n", chunk)]
                for line, size in zip([b"".join(begun), *lines[:-1]], sizes, strict=True):
                    if end is not None and at >= end:
                        return
                    number, at = number + 1, at + len(line) + size
                    yield number, line.decode("utf-8", "ignore")
                begun = [lines[-1]]
            last = b"".join(begun).decode("utf-8", "ignore")
            if last and (end is None or at < end):
                yield number + 1, last
    except OSError:
        return


@dataclass
class Batch(InputPartition):
    """Whole files: (number in the order of paths, path)."""

    units: list[tuple[int, str]]


@dataclass
class Slice(InputPartition):
    number: int
    path: str
    slice: int
    start: int
    end: int


@dataclass
class Staged(InputPartition):
    pass


COLUMNS = {"file_path": 0, "commit_hash": 1}
TESTS: dict[type, Callable] = {
    StringStartsWith: lambda v, x: v is not None and v.startswith(x), StringEndsWith: lambda v, x: v is not None and v.endswith(x), StringContains: lambda v, x: v is not None and x in v,
    EqualTo: lambda v, x: v is not None and x is not None and v == x, EqualNullSafe: lambda v, x: v == x, In: lambda v, x: v is not None and v in x,
}


def test_of(f: Filter) -> tuple[str, Callable[[str | None], bool]] | None:
    """The column and the test of a filter, if the source can decide it."""
    if isinstance(f, Not):
        inner = test_of(f.child)
        known = isinstance(f.child, (EqualTo, In, *list(TESTS)[:3]))
        # a null is neither equal nor unequal
        return (inner[0], lambda v: v is not None and not inner[1](v)) if inner and known and getattr(f.child, "value", 0) is not None else None
    if getattr(f, "attribute", None) not in {(c,) for c in COLUMNS}:
        return None
    column = f.attribute[0]
    if isinstance(f, (IsNull, IsNotNull)):
        null = isinstance(f, IsNull)
        return column, lambda v: (v is None) is null
    if type(f) in TESTS:
        test, value = TESTS[type(f)], f.value
        return column, lambda v: test(v, value)
    return None


class Wanted:
    """Ignore rules and pushed filters. Filters are kept as they came, since tests of them do not travel to executors."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns, self.filters = patterns, []
        self.ready: tuple | None = None

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns, "filters": self.filters, "ready": None}

    def tests(self) -> tuple[IgnoreRules, dict[str, list[Callable]]]:
        if self.ready is None:
            by: dict[str, list[Callable]] = {c: [] for c in COLUMNS}
            for f in self.filters:
                column, test = test_of(f)
                by[column].append(test)
            self.ready = IgnoreRules(self.patterns), by
        return self.ready

    def path(self, path: str) -> bool:
        rules, by = self.tests()
        return not rules(path) and all(t(path) for t in by["file_path"])

    def commit(self, name: str | None) -> bool:
        return all(t(None if name is None else name[:HASH]) for t in self.tests()[1]["commit_hash"])


class RepoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.mode = options.get("mode", "tree")
        self.wanted = Wanted(json.loads(options.get("patterns", "[]")))
        self.limit = int(options.get("max_commits", 0))
        self.size = int(options.get("batch", 200))
        self.bytes = int(options.get("batch_bytes", 64_000_000))  # of a batch, but for one file that is larger
        self.split = int(options.get("split_bytes", 0))  # files above it are left to the mode slices

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.mode != "slice_counts" and test_of(f) is not None:
                self.wanted.filters.append(f)
                self.wanted.ready = None
            else:
                yield f

    def files(self) -> Iterator[tuple[int, str, int]]:
        """(number, path, size) of the wanted files."""
        if self.wanted.commit(None):
            for n, path in enumerate(tree_files(self.root, self.wanted.patterns)):
                if self.wanted.path(path):
                    yield n, path, file_size(self.root, path)

    def partitions(self) -> list[InputPartition]:
        if self.mode == "staged":
            return [Staged()] if self.wanted.commit(None) else []
        if self.mode == "history":
            names = git(self.root, "rev-list", "--all", *([f"-n{self.limit}"] if self.limit else [])).split()
            kept = [(i, x) for i, x in enumerate(names) if self.wanted.commit(x)]
            found = history.batches(self.root, [x for _, x in kept], self.wanted.path, self.size, self.bytes)
            place = dict(enumerate(i for i, _ in kept))  # order keys follow the whole history
            for part in found:
                if isinstance(part, history.PathBatch):
                    part.index = place[part.index]
                else:
                    part.commits = [(name, place[i]) for name, i in part.commits]
            return found
        if self.mode in ("slices", "slice_counts"):
            return [Slice(n, path, k, at, at + self.split) for n, path, size in self.files() if size > self.split for k, at in enumerate(range(0, size, self.split))]
        out: list[Batch] = []
        held = self.bytes + 1
        for n, path, size in self.files():
            if self.split and size > self.split:
                continue
            if held + size > self.bytes or len(out[-1].units) >= self.size:
                out.append(Batch([]))
                held = 0
            out[-1].units.append((n, path))
            held += size
        return out

    def read(self, part: InputPartition | None) -> Iterator[tuple]:
        if part is None:  # there are no partitions
            return
        if isinstance(part, Batch):
            for n, path in part.units:
                for number, line in file_lines(self.root, path):
                    yield path, None, number, line, n * PER_UNIT + number
        elif isinstance(part, Slice):
            lines = file_lines(self.root, part.path, part.start, part.end)
            if self.mode == "slice_counts":
                yield part.path, part.slice, sum(1 for _ in lines)
            else:
                for number, line in lines:
                    yield part.path, None, number, line, part.number * PER_UNIT + number, part.slice
        elif isinstance(part, Staged):
            log = git_lines(self.root, "diff", "--cached", "--no-color", "-U0", "--diff-filter=ACM")
            for n, (path, _, number, line) in enumerate(added_lines(log, self.wanted.path)):
                yield path, None, number, line, n
        else:
            yield from history.read_batch(self.root, part, self.wanted.path, lambda i: HISTORY + i * PER_UNIT)


class CommitStream(DataSourceStreamReader):
    """New commits of all branches. An offset is the set of commits that its tips reach, as the tips' names and their number; a
    batch has the commits that its end reaches and its start does not, so every commit comes once, whatever is merged, and after a
    restart too. A tip that a rewritten branch has left stays in the offset while the stream runs."""

    def __init__(self, options: dict) -> None:
        self.inner = RepoReader(options | {"mode": "history"})
        self.tips: list[str] = []

    def tips_of(self, names: list[str]) -> list[str]:
        """The tips among names that still exist, without those that another one reaches."""
        there = [x for x in dict.fromkeys(names) if x and self.known(x)]
        return sorted(git(self.inner.root, "merge-base", "--independent", *there).split()) if len(there) > 1 else there

    def known(self, name: str) -> bool:
        try:
            git(self.inner.root, "cat-file", "-e", f"{name}^{{commit}}")
        except ScanError:
            return False
        return True

    def offset(self, tips: list[str]) -> dict:
        count = int(git(self.inner.root, "rev-list", "--count", *tips)) if tips else 0
        return {"tips": tips, "count": count}

    def initialOffset(self) -> dict:
        return {"tips": [], "count": 0}

    def latestOffset(self) -> dict:
        refs = git(self.inner.root, "for-each-ref", "--format=%(*objectname)%(objectname)").split()
        heads = [x[:40] if len(x) in (80, 128) else x for x in refs]
        self.tips = self.tips_of([*self.tips, *heads])
        return self.offset(self.tips)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        gone = [f"^{x}" for x in start["tips"] if self.known(x)]
        self.tips = self.tips or list(end["tips"])
        if not end["tips"]:
            return []
        names = git(self.inner.root, "rev-list", "--reverse", "--topo-order", *end["tips"], *gone).split()
        return history.batches(self.inner.root, names, self.inner.wanted.path, self.inner.size, self.inner.bytes, int(start["count"]))

    def read(self, part: InputPartition | None) -> Iterator[tuple]:
        if part is not None:
            yield from history.read_batch(self.inner.root, part, self.inner.wanted.path, lambda i: HISTORY + (STREAMED - i) * PER_UNIT)

    def commit(self, end: dict) -> None:
        """Nothing is kept: offsets say all."""


class RepoLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_lines"

    def schema(self) -> str:
        mode = dict(self.options).get("mode", "tree")
        return "file_path string, slice int, lines bigint" if mode == "slice_counts" else SCHEMA + ", slice int" * (mode == "slices")

    def reader(self, schema) -> RepoReader:
        return RepoReader(dict(self.options))

    def streamReader(self, schema) -> CommitStream:
        return CommitStream(dict(self.options))


def _options(spark: SparkSession, path: str, mode: str, patterns: list[str] | None, **more: int | None) -> dict[str, str]:
    spark.dataSource.register(RepoLines)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", None) != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return {"path": path, "mode": mode, "patterns": json.dumps(patterns or [])} | {k: str(v) for k, v in more.items() if v}


def repo_lines(spark: SparkSession, path: str, mode: str = "tree", patterns: list[str] | None = None, max_commits: int | None = None, split_bytes: int = SPLIT, broadcast_rows: int = 100_000) -> DataFrame:
    """The lines of a tree, a history, or what is staged. Files above split_bytes are read in slices by several tasks: their lines
    are counted first, and a running sum of the counts gives each slice's first line number."""
    source = lambda mode: spark.read.format("repo_lines").options(**_options(spark, path, mode, patterns, max_commits=max_commits, split_bytes=split_bytes if mode in ("tree", "slices", "slice_counts") else None)).load()
    lines = source(mode)
    if mode != "tree" or not split_bytes or not any(file_size(path, x) > split_bytes for x in tree_files(path, patterns or [])):
        return lines
    before = Window.partitionBy("file_path").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = source("slice_counts").select("file_path", "slice", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"))
    parts = source("slices")
    # one row for each slice; a tree of more slices than that is joined by a shuffle of its lines
    few = sum(-(-n // split_bytes) for x in tree_files(path, patterns or []) if (n := file_size(path, x)) > split_bytes) <= broadcast_rows
    placed = parts.join(F.broadcast(bases) if few else bases, ["file_path", "slice"])
    return lines.unionByName(placed.select("file_path", "commit_hash", (F.col("line_number") + F.col("base")).cast("int").alias("line_number"), "line_content", (F.col("seq") + F.col("base")).alias("seq")))


def commit_stream(spark: SparkSession, path: str, patterns: list[str] | None = None, batch: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """A stream of the lines that new commits add, the commits already there first; the columns of repo_lines."""
    return spark.readStream.format("repo_lines").options(**_options(spark, path, "history", patterns, batch=batch, batch_bytes=batch_bytes)).load()


GITHUB = re.compile(r"^\s*(?:https?://|git@)(?:www\.)?github\.com[/:].+", re.I)


def is_remote(target: str) -> bool:
    return bool(GITHUB.match(target))


def staged_paths(path: str) -> list[str]:
    """Paths of files that are staged as added, copied or modified; none outside a repository."""
    try:
        root = git(path, "rev-parse", "--show-toplevel", timeout=30).strip()
        return [x for x in git(root, "diff", "--cached", "--name-only", "-z", "--diff-filter=ACM", timeout=60).split("\0") if x]
    except ScanError:
        return []


def resolve_target(target: str, clone_to: str) -> str:
    """A folder's absolute path; a GitHub address is cloned into the folder clone_to, which executors must see."""
    if is_remote(target):
        git(".", "clone", "--quiet", target.strip(), clone_to, timeout=300)
        return clone_to
    if not os.path.isdir(target):
        raise ScanError(f"{target} is no folder")
    return os.path.abspath(target)
