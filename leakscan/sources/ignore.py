"""Ignore rules in the syntax of gitignore, as a compiled matcher and as a column expression."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_NAME = ".leakignore"
# What a scan leaves out unless it is told to be full.
DEFAULT_IGNORES = [
    ".git/", "node_modules/", "venv/", ".venv/", "__pycache__/", "*.pyc", "dist/", "build/", "*.min.js", "*.map", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.pdf", "*.zip", "*.tar", "*.gz", "*.tgz", "*.7z",
    "*.mp4", "*.mp3", "*.mov", "*.avi", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.exe", "*.dll", "*.so", "*.dylib", "*.bin",
]


def rule(pattern: str) -> tuple[str, bool] | None:
    """A pattern's regular expression over relative paths, and whether it ignores (or, after !, includes); None for blanks
    and comments."""
    p = pattern.rstrip("\n")
    p = re.sub(r"(?<!\\)\s+$", "", p)
    if not p or p.startswith("#"):
        return None
    keep = p.startswith("!")
    p = p[1:] if keep else p
    p = p[1:] if p[:2] in ("\\#", "\\!") else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p[i] == "*":
            out += "[^/]*"
            while p[i : i + 1] == "*":
                i += 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            body = p[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            i += p[i] == "\\" and i + 1 < len(p)
            out, i = out + re.escape(p[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), not keep


class IgnoreRules:
    """The last rule that matches decides."""

    def __init__(self, patterns: list[str]) -> None:
        self.rules = [(re.compile(r[0]), r[1]) for p in patterns if (r := rule(p))]

    def __call__(self, path: str) -> bool:
        path = path.replace("\\", "/")
        return next((sign for regex, sign in reversed(self.rules) if regex.match(path)), False)

    def prunes(self, folder: str) -> bool:
        """Whether nothing below a folder can be scanned: it is ignored and no rule includes anything again."""
        return all(sign for _, sign in self.rules) and self(folder.rstrip("/") + "/x")


def ignored(path: Column, patterns: list[str]) -> Column:
    verdict = F.lit(False)
    for p in patterns:
        if r := rule(p):
            verdict = F.when(F.replace(path, F.lit("\\"), F.lit("/")).rlike(r[0]), r[1]).otherwise(verdict)
    return verdict


def glob_regex(pattern: str) -> str:
    """A shell pattern over a whole path as a regular expression; stars match slashes too."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        end = pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end > 0:
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", pattern[i:end].removeprefix("!"))
            out, i = out + ("[^" if pattern[i] == "!" else "[") + body + "]", end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


class GlobRules:
    """The reduced matcher: patterns are globs for a whole path or what follows a folder, any of them decides, and there is no
    negation. One that ends with a slash also stands for what lies below a folder of that very name."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns = [p for p in patterns if p]
        bare = [p.rstrip("/") for p in self.patterns]
        self.globs = [glob_regex(x) for p in bare for x in (p, f"*/{p}")]
        self.folders = [b + "/" for p, b in zip(self.patterns, bare, strict=True) if p.endswith("/")]

    def __call__(self, path: str) -> bool:
        path = path.replace("\\", "/")
        return any(re.match(g, path) for g in self.globs) or any(path.startswith(f) or "/" + f in path for f in self.folders)

    def column(self, path: Column) -> Column:
        path, verdict = F.replace(path, F.lit("\\"), F.lit("/")), F.lit(False)
        for g in self.globs:
            verdict = verdict | path.rlike(g)
        for f in self.folders:
            verdict = verdict | F.startswith(path, F.lit(f)) | F.contains(path, F.lit("/" + f))
        return verdict


def read_patterns(path: str) -> list[str]:
    """Patterns of a file, one to a line; none without a file."""
    try:
        with open(path, encoding="utf-8", errors="ignore") as f:
            return [x.rstrip("\n") for x in f if x.strip() and not x.startswith("#")]
    except FileNotFoundError:
        return []


def scan_patterns(root: str, extra: list[str] | tuple[str, ...] = (), defaults: bool = True) -> list[str]:
    """Defaults, then the target's own file, then explicit ones."""
    return (DEFAULT_IGNORES if defaults else []) + read_patterns(os.path.join(root, IGNORE_NAME)) + list(extra)
