"""Commits of a git repository as units of work: listed with what they weigh, packed into batches, and read as added lines.

What a commit weighs is the size of the blobs that it adds or changes, which its trees tell without any diff. A batch holds
commits up to a weight and a number; a commit above the weight is split by path. So no task has more than one file above the bound.
"""

from __future__ import annotations

import codecs
import io
import re
import subprocess
import threading
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import InputPartition

from ..operators.gitlog import COMMIT, DIFF, HUNK

PER_UNIT = 1 << 34  # order keys of a file's or a commit's lines
HASH = 12  # shown characters of a commit's hash
QUIET = ("-c", "core.quotePath=false", "-c", "diff.renames=true", "-c", "log.showSignature=false")


class ScanError(ValueError):
    """A target that cannot be scanned."""


def git(root: str, *args: str, given: str | None = None, timeout: int = 600) -> str:
    try:
        done = subprocess.run(["git", "-C", root, *QUIET, *args], input=None if given is None else given.encode(), capture_output=True, timeout=timeout, check=True)
    except FileNotFoundError as e:
        raise ScanError("git is not installed") from e
    except subprocess.TimeoutExpired as e:
        raise ScanError(f"git {args[0]} took over {timeout} s") from e
    except subprocess.CalledProcessError as e:
        raise ScanError(e.stderr.decode(errors="replace").strip() or f"git {args[0]} failed") from e
    return done.stdout.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def git_bytes(root: str, *args: str, given: str = "", timeout: int = 600) -> Iterator[bytes]:
    """The output of git as it comes: it is never held whole. given: input of any length."""
    try:
        run = subprocess.Popen(["git", "-C", root, *QUIET, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
    except FileNotFoundError as e:
        raise ScanError("git is not installed") from e
    late = threading.Timer(timeout, run.kill)
    late.start()

    def feed() -> None:
        try:
            with run.stdin as pipe:
                pipe.write(given.encode())
        except BrokenPipeError:
            pass  # git has ended; its exit code tells why

    feeder = threading.Thread(target=feed, daemon=True)
    feeder.start()
    try:
        while chunk := run.stdout.read1(1 << 16):
            yield chunk
        if run.wait():
            raise ScanError(f"git {args[0]} failed or took over {timeout} s")
    finally:
        late.cancel()
        run.kill()
        run.stdout.close()
        run.wait()


def git_lines(root: str, *args: str, given: str = "", timeout: int = 600) -> Iterator[str]:
    """The output of git, line by line; all line ends are one."""
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("ignore"), translate=True)
    rest = ""
    for chunk in git_bytes(root, *args, given=given, timeout=timeout):
        *lines, rest = (rest + decoder.decode(chunk)).split("\n")
        for line in lines:
            yield from line.splitlines() or [""]
    if rest := rest + decoder.decode(b"", final=True):
        yield from rest.splitlines()


def added_lines(log: Iterable[str], wanted: Callable[[str], bool]) -> Iterator[tuple[str, str | None, int, str]]:
    """(path, commit, line number, text) of the added lines of a log or diff in the wanted files."""
    commit = path = number = None
    for raw in log:
        if m := re.match(COMMIT, raw):
            commit, path, number = m[1][:HASH], None, None
        elif m := re.match(DIFF, raw):
            path, number = (m[1] if wanted(m[1]) else None), None
        elif m := re.match(HUNK, raw):
            number = int(m[1])
        elif path is not None and number is not None and not raw.startswith(("-", "+++")):
            if raw.startswith("+"):
                yield path, commit, number, raw[1:]
            number += 1


@dataclass
class Commit:
    """files: (path, what it was renamed from, weight), in the order of the commit's diff."""

    name: str
    index: int
    files: list[tuple[str, str | None, int]]


@dataclass
class CommitBatch(InputPartition):
    """Whole commits: (name, index). weight: of what is read, for tests and logs."""

    commits: list[tuple[str, int]]
    weight: int = 0


@dataclass
class PathBatch(InputPartition):
    """Some files of one commit: (path, renamed from, the order key of its first line)."""

    name: str
    index: int
    files: list[tuple[str, str | None, int]]
    weight: int = 0


def changes(root: str, names: list[str]) -> Iterator[tuple[str, list[tuple[str, str | None, str]]]]:
    """Of each commit the files that it adds or changes: (path, what it was renamed from, the new blob's id)."""

    def tokens() -> Iterator[str]:
        rest = b""
        for chunk in git_bytes(root, "log", "--no-walk=unsorted", "--stdin", "-z", "--raw", "-M", "--no-abbrev", "--format=format:%x02%H", given="\n".join(names) + "\n"):
            *done, rest = (rest + chunk).split(b"\0")
            yield from (x.decode("utf-8", "surrogateescape") for x in done)
        yield rest.decode("utf-8", "surrogateescape")

    name, files, entry = None, [], []  # entry: a change whose paths are to come, as blob, kind, paths
    for token in tokens():
        if entry:
            entry.append(token)
            if entry[1] in "RC" and len(entry) == 3:
                continue  # the new path follows the old one
            if entry[1] != "D":
                files.append((entry[-1], entry[2] if entry[1] in "RC" else None, entry[0]))
            entry = []
            continue
        if token.startswith("\x02"):
            if name:
                yield name, files
            name, _, token = token[1:].partition("\n")
            files = []
        if token.startswith(":"):
            *_, blob, kind = token.split(" ")
            entry = [blob, kind[0]]
    if name:
        yield name, files


def blob_sizes(root: str, ids: set[str]) -> dict[str, int]:
    told = git(root, "cat-file", "--batch-check=%(objectname) %(objectsize)", given="\n".join(sorted(ids)) + "\n") if ids else ""
    return {x[0]: int(x[1]) for line in told.splitlines() if len(x := line.split()) == 2 and x[1].isdigit()}


def weighed(root: str, names: list[str], step: int = 2000) -> Iterator[Commit]:
    """The commits, oldest or newest first as given, with their files' weights; a few at a time are held."""
    for at in range(0, len(names), step):
        found = dict(changes(root, names[at : at + step]))
        sizes = blob_sizes(root, {x for files in found.values() for *_, x in files})
        for i, name in enumerate(names[at : at + step], at):
            yield Commit(name, i, [(p, old, sizes.get(x, 0) + 1) for p, old, x in found.get(name, [])])


def batches(root: str, names: list[str], wanted: Callable[[str], bool], size: int, weight: int, first: int = 0) -> list[CommitBatch | PathBatch]:
    """Partitions over the commits, without those that change no wanted file."""
    out: list[CommitBatch | PathBatch] = []
    held = CommitBatch([])
    for c in weighed(root, names):
        bases, at = [], 0
        for path, old, w in c.files:
            if wanted(path):
                bases.append((path, old, at, w))
            at += w  # a file has no more lines than bytes, and one
        if not bases:
            continue
        total = sum(x[3] for x in bases)
        if total > weight and len(bases) > 1:
            for renamed in (False, True):  # renames are found again where both names are asked for, and only there
                part = PathBatch(c.name, first + c.index, [])
                for path, old, base, w in bases:
                    if (old is not None) is not renamed:
                        continue
                    if part.files and part.weight + w > weight:
                        out.append(part)
                        part = PathBatch(c.name, first + c.index, [])
                    part.files.append((path, old, base))
                    part.weight += w
                if part.files:
                    out.append(part)
            continue
        if held.commits and (held.weight + total > weight or len(held.commits) >= size):
            out.append(held)
            held = CommitBatch([])
        held.commits.append((c.name, first + c.index))
        held.weight += total
    return [*out, held] if held.commits else out


def read_batch(root: str, part: CommitBatch | PathBatch, wanted: Callable[[str], bool], key: Callable[[int], int]) -> Iterator[tuple]:
    """Rows of a partition; key: the order key of a commit's first line by its index."""
    shape = ("-p", "--no-color", "--unified=0", "--no-walk=unsorted", "--format=medium")
    if isinstance(part, CommitBatch):
        index = {name[:HASH]: i for name, i in part.commits}
        at: dict[str, int] = {}
        log = git_lines(root, "log", *shape, "-M", "--stdin", given="\n".join(name for name, _ in part.commits) + "\n")
        for path, commit, number, line in added_lines(log, lambda _: True):
            n = at[commit] = at.get(commit, -1) + 1  # order keys count all lines, so filters do not change them
            if wanted(path):
                yield path, commit, number, line, key(index[commit]) + n
        return
    # paths are given literally, through standard input, as there may be many
    paths = [x for p, old, _ in part.files for x in (p, old) if x is not None]
    bases = {p: base for p, _, base in part.files}
    found: dict[str, int] = {}
    log = git_lines(root, "--literal-pathspecs", "log", *shape, "-M" if part.files[0][1] is not None else "--no-renames", "--stdin", given="\n".join([part.name, "--", *paths]) + "\n")
    for path, commit, number, line in added_lines(log, lambda p: p in bases and wanted(p)):
        n = found[path] = found.get(path, -1) + 1
        yield path, commit, number, line, key(part.index) + bases[path] + n

