"""Both detectors as column expressions: a line becomes an array of hits, without a shuffle and without Python.

A hit is (type, matched_string, start_col, end_col, entropy_score), with 0-based half-open columns in code points. The start
of a match is the next place of its text, or, where matches are many, follows from the text between them, which splitting by the same
expression yields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import BLANK, FOLDS, HINTS, NEEDED, Signature, begun, default_signatures, quick_blanks
from ..functions.plan import bound, let, running
from ..functions.text import entropy

HIT = "struct<type: string, matched_string: string, start_col: int, end_col: int, entropy_score: double>"
# Thresholds and words of the entropy detector.
ENTROPY_THRESHOLD = 3.5
MIN_LENGTH = 12
CONTEXT_WORDS = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "credential")
COMMON_WORDS = ("password", "changeme", "change_me", "example", "placeholder", "development", "production", "localhost", "administrator", "username", "letmein", "temporary", "undefined", "notasecret", "testing", "hunter2")
LOOKUPS = r"(?iu)os\.environ|os\.getenv|\bgetenv\s*\(|process\.env\b|\bENV\s*\[|System\.getenv|\$\{[^}]*\}|\{\{[^}]*\}\}|<%=?[^%]*%>"
# possessive where what follows a run cannot be part of it: the same matches, without a search that grows with the square of a word
ASSIGNMENT = r"""['"]?([A-Za-z_][A-Za-z0-9_\-]{1,60}+)['"]?+[BLANK]*+[:=][BLANK]*+(?:'([^']*)'|"([^"]*)"|([^BLANK,;#]+))""".replace("BLANK", BLANK)
QUOTED = r"""'([^']*)'|"([^"]*)\""""
# what precedes an assignment's value, and the same search as the JVM runs it
BEFORE_VALUE = quick_blanks(r"""^['"]?[A-Za-z0-9_\-]++['"]?+[BLANK]*+[:=][BLANK]*+""".replace("BLANK", BLANK))
_ASSIGNMENT = quick_blanks(ASSIGNMENT)
_HINTS, _LOOKUPS = begun(HINTS, "aceghkpstx:"), begun(LOOKUPS, "egops${<")
FEW = 8  # matches that are looked up one by one, and intervals that are simply compared with each other


def matches(line: Column, regex: str, groups: tuple[int, ...]) -> Column:
    """All matches, left to right: structs of `at` (0-based start), `full`, and g0, g1 ... for the groups (empty if unmatched)."""
    kind = "struct<at: int, full: string>"

    def swept(found: Column) -> Column:
        # the last gap follows the last match and has none of its own
        both = F.filter(F.arrays_zip(found.alias("full"), F.split(line, regex, -1).alias("gap")), lambda x: x["full"].isNotNull())
        ends = lambda at, x: at + F.length(x["gap"]) + F.length(x["full"])
        # the array is bound, as it is looked at several times
        return let(both, lambda found: running(found, F.lit(0), ends, lambda at, x: F.struct((at + F.length(x["gap"])).alias("at"), x["full"].alias("full")), kind))

    def sought(found: Column) -> Column:
        # where a text that matches stands, a match begins, so the first place of a match's text after the last match is its own
        def one(s: Column, full: Column) -> Column:
            return let(F.call_function("locate", full, line, s["end"] + 1) - 1, lambda at: F.struct((at + F.length(full)).alias("end"), F.concat(s["out"], F.array(F.struct(at.alias("at"), full.alias("full")))).alias("out")))

        return F.aggregate(found, F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{kind}>").alias("out")), one, lambda s: s["out"])

    def first(found: Column) -> Column:
        return F.array(F.struct((F.call_function("locate", found[0], line) - 1).alias("at"), found[0].alias("full")))

    # few lines have many matches, and most have one or none, which take no fold
    placed = let(F.regexp_extract_all(line, F.lit(regex), 0), lambda found: F.when(F.size(found) == 0, F.array().cast(f"array<{kind}>")).when(F.size(found) == 1, first(found)).when(F.size(found) <= FEW, sought(found)).otherwise(swept(found)))
    if not groups:
        return placed
    return F.transform(placed, lambda m: F.struct(m["at"].alias("at"), m["full"].alias("full"), *[F.regexp_extract(m["full"], regex, g).alias(f"g{n}") for n, g in enumerate(groups)]))


def assignments(line: Column) -> Column:
    """All assignments, left to right: structs of name, value (without quotes) and `at` (0-based start of the value).

    A match says itself which form it has: a value in quotes begins and ends with one of a kind and holds no other; a bare one
    that begins with a quote has no second of its kind on the line."""

    def parted(m: Column) -> Column:
        return let(F.regexp_replace(m["full"], BEFORE_VALUE, ""), lambda v: F.when(
            (F.length(v) > 1) & (F.startswith(v, F.lit("'")) & F.endswith(v, F.lit("'")) | F.startswith(v, F.lit('"')) & F.endswith(v, F.lit('"'))),
            placed(m, F.substring(v, F.lit(2), F.length(v) - 2), 1),
        ).otherwise(placed(m, v, 0)))

    def placed(m: Column, value: Column, quote: int) -> Column:
        name = F.regexp_extract(m["full"], r"[A-Za-z0-9_\-]+", 0)
        return F.struct(name.alias("name"), value.alias("value"), (m["at"] + F.length(m["full"]) - F.length(value) - quote).alias("at"))

    return F.transform(matches(line, _ASSIGNMENT, ()), parted)


def quoted_strings(line: Column) -> Column:
    """All strings in quotes, left to right: structs of value (without quotes) and `at` (its 0-based start)."""
    return F.transform(matches(line, QUOTED, ()), lambda m: F.struct(F.substring(m["full"], F.lit(2), F.length(m["full"]) - 2).alias("value"), (m["at"] + 1).alias("at")))


def _hit(kind: str, text: Column, at: Column, score: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("matched_string"), at.cast("int").alias("start_col"), (at + F.length(text)).cast("int").alias("end_col"), (F.lit(None).cast("double") if score is None else score).alias("entropy_score"))


def none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds one of some literals: bytes are compared, which takes a small part of a regex's time."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def folded(line: Column) -> Column:
    """The line in lower case, as (?iu) of the JVM compares ASCII letters: literals in lower case are sought in it."""
    pairs = [(c, letter) for letter, odd in FOLDS.items() for c in odd]
    plain = F.translate(line, "".join(c for c, _ in pairs), "".join(x for _, x in pairs))
    return F.lower(F.when((F.length(line) < F.octet_length(line)) & holds(line, tuple(c for c, _ in pairs)), plain).otherwise(line))


def may_match(line: Column, low: Column, signature: Signature) -> Column | None:
    """Whether a line holds a literal that a built-in signature needs; None for others. low: the line, folded."""
    words = NEEDED.get(signature.regex)
    return words and holds(low if signature.flags else line, words)


def signature_hits(line: Column, signature: Signature, low: Column | None = None) -> Column:
    """All hits of one signature. low: the line, folded, if there is such a column."""
    group, tail = signature.group, signature.tail or 0
    value = lambda m: m["g0"] if group else m["full"]
    at = lambda m: m["at"] + F.length(m["full"]) - tail - F.length(m["g0"]) if group else m["at"]
    found = F.transform(matches(line, signature.native, (group,) if group else ()), lambda m: _hit(signature.type, value(m), at(m)))
    there = None if low is None else may_match(line, low, signature)
    return F.when(line.rlike(signature.native) if there is None else there, found).otherwise(none())


def regex_hits(line: Column, signatures: list[Signature] | None = None, low: Column | None = None) -> Column:
    """Hits of all signatures, in their order, each left to right."""
    return F.concat(*[signature_hits(line, s, low) for s in signatures or default_signatures()])


def suspicious(text: Column, words: tuple[str, ...] = CONTEXT_WORDS) -> Column:
    words = tuple(w.lower() for w in words)
    return holds(F.lower(text), words) if words else F.lower(text).rlike("")


def possible_secret(value: Column, min_length: int = MIN_LENGTH) -> Column:
    """False for values whose structure rules a secret out."""
    # a colour with a line break behind it has 8 characters
    long = (F.length(value) >= min_length) if min_length > 8 else (F.length(value) >= min_length) & ~value.rlike(r"^#?[0-9A-Fa-f]{3}(?:[0-9A-Fa-f]{3})?$")
    return (
        long
        & ~value.rlike(r"^\p{Nd}+$")
        & ~value.rlike(r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
        & ~value.rlike(_LOOKUPS)
        & ~value.rlike(quick_blanks(f"[{BLANK}]"))
        & ~F.lower(value).isin(*COMMON_WORDS)
    )


def path_like(value: Column) -> Column:
    return value.rlike(r"^(?:/|\./|\.\./|https?://)")


def entropy_hits(line: Column, threshold: float = ENTROPY_THRESHOLD, min_length: int = MIN_LENGTH, words: tuple[str, ...] = CONTEXT_WORDS, told: Column | None = None) -> Column:
    """Random-looking values of suspicious names, then of quoted strings on suspicious lines that no assignment has taken.
    told: whether the line is suspicious, if that is known."""
    pairs = assignments(line)
    # what is too short takes no further tests
    quoted = F.when(holds(line, ("'", '"')), F.filter(quoted_strings(line), lambda q: F.length(q["value"]) >= min_length)).otherwise(F.array().cast("array<struct<value: string, at: int>>"))

    def scored(found: Column) -> Column:
        good = F.filter(found, lambda x: possible_secret(x["value"], min_length))
        with_score = F.transform(good, lambda x: F.struct(x["value"].alias("value"), x["at"].alias("at"), entropy(x["value"]).alias("h")))
        return F.transform(F.filter(with_score, lambda x: x["h"] >= threshold), lambda x: _hit("HIGH_ENTROPY", x["value"], x["at"], F.bround(x["h"], 2)))

    # a one-element array binds the assignments once for both passes
    both = F.transform(F.array(pairs), lambda taken: F.concat(
        scored(F.transform(F.filter(taken, lambda p: suspicious(p["name"], words)), lambda p: F.struct(p["value"].alias("value"), p["at"].alias("at")))),
        scored(let(F.filter(quoted, lambda q: ~path_like(q["value"])), lambda q: free(q, taken))),
    ))
    return F.when(suspicious(line, words) if told is None else told, F.flatten(both)).otherwise(none())


def free(quoted: Column, taken: Column) -> Column:
    """The quoted strings that start or end in no assigned value. Both arrays are in order and their intervals disjoint, so of
    many ones only the last value that begins before a string's start, and before its end, has to be looked at."""

    def ends_of_last(place: Callable[[Column], Column], late: int) -> Column:
        """By the number of each string: the end of the last value that begins before a place of it; late: on ties."""
        value = F.transform(taken, lambda p: F.struct(p["at"].alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("i"), (p["at"] + F.length(p["value"])).alias("end")))
        string = F.transform(quoted, lambda q, i: F.struct(place(q).alias("at"), F.lit(late).alias("kind"), i.alias("i"), F.lit(-1).alias("end")))
        merged = F.sort_array(F.concat(value, string))
        last = let(merged, lambda m: running(m, F.lit(-1), lambda end, x: F.when(x["kind"] == 1, x["end"]).otherwise(end), lambda end, x: F.struct(x["i"].alias("i"), end.alias("end")), "struct<i: int, end: int>"))
        return F.transform(F.sort_array(F.filter(last, lambda x: x["i"] >= 0)), lambda x: x["end"])

    def swept(starts: Column, ends: Column) -> Column:
        marked = F.arrays_zip(quoted.alias("q"), starts.alias("s"), ends.alias("e"))
        left = F.filter(marked, lambda x: ~((x["q"]["at"] < x["s"]) | (x["q"]["at"] + F.length(x["q"]["value"]) <= x["e"])))
        return F.transform(left, lambda x: x["q"])

    many = swept(ends_of_last(lambda q: q["at"], 2), ends_of_last(lambda q: q["at"] + F.length(q["value"]), 0))
    few = F.filter(quoted, lambda q: ~F.exists(taken, lambda p: _touches(p, q)))
    return F.when((F.size(quoted) <= FEW) | (F.size(taken) <= FEW), few).otherwise(many)


def _touches(p: Column, q: Column) -> Column:
    s, e = p["at"], p["at"] + F.length(p["value"])
    a, b = q["at"], q["at"] + F.length(q["value"])
    return ((s <= a) & (a < e)) | ((s < b) & (b <= e))


def python_hits(lines: DataFrame, signatures: list[Signature]) -> DataFrame:
    """lines with a column py_hits for signatures whose spans Spark's own functions cannot give (look-around, anchors)."""
    compiled = [(s.type, s.regex, s.flags) for s in signatures]

    def detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rules = [(t, re.compile(r, sum((getattr(re, f) for f in flags), re.RegexFlag(0)))) for t, r, flags in compiled]
        for b in batches:
            out = []
            for line in b:
                hits = []
                for t, r in rules:
                    for m in r.finditer(line or ""):
                        g = "value" if "value" in r.groupindex else 0
                        hits.append({"type": t, "matched_string": m.group(g), "start_col": m.start(g), "end_col": m.end(g), "entropy_score": None})
                out.append(hits)
            yield pd.Series(out)

    return lines.withColumn("py_hits", F.pandas_udf(detect, f"array<{HIT}>")("line_content"))


LOW, MARKS = "folded line", "marks"  # columns beside a line's own
# context words, and what the signatures need, in as few searches as will do: key headers hold "key", webhooks "://"
_LOW_HINTS = ("key", "token", "secret", "passw", "pwd", "auth", "credential", "://")
_OWN_HINTS = ("AKIA", "xox", "eyJ", "AIza")
_JOINED_HINTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_")


def hinted(lines: DataFrame, keep: bool = False) -> DataFrame:
    """lines without those that hold no literal which any built-in signature or context word needs. keep: with the folded line."""
    marked = bound(lines.where(F.col("line_content") != ""), **{LOW: folded(F.col("line_content"))})
    left = marked.where(holds(F.col(LOW), _LOW_HINTS) | holds(F.col("line_content"), _OWN_HINTS) | F.contains("line_content", F.lit("_")) & holds(F.col("line_content"), _JOINED_HINTS))
    return left if keep else left.drop(LOW)


def marked(lines: DataFrame) -> DataFrame:
    """hinted() with the folded line, and which literals it holds as a column of booleans: each is sought once for all its uses."""
    line, low = F.col("line_content"), F.col(LOW)
    rows = bound(lines.where(line != ""), **{LOW: folded(line)})
    there = {w: F.contains(low, F.lit(w)) for w in _LOW_HINTS} | {w: F.contains(line, F.lit(w)) for w in _OWN_HINTS}
    there |= {"joined": F.contains(line, F.lit("_")) & holds(line, _JOINED_HINTS), "quote": holds(line, ('"', "'"))}
    rows = bound(rows, **{MARKS: F.struct(*[c.alias(name) for name, c in there.items()])})
    return rows.where(reduce(lambda a, b: a | b, [F.col(MARKS)[name] for name in there if name != "quote"]))


#: Of each built-in signature, marks of which a line with a match has one of each group.
_IMPLIED = dict(zip(NEEDED, (
    [("AKIA",)], [("quote",), ("key",), ("secret",)], [("quote",), ("key",)], [("quote",), ("token", "secret")], [("quote",), ("passw", "pwd")], [("xox",)], [("://",)], [("key",)],
    [("://",)], [("eyJ",)], [("joined",)], [("AIza",)], [("joined",)],
), strict=True))


def marked_hits(line: Column, signature: Signature) -> Column:
    """signature_hits() of marked() lines: literals are sought only where the marks leave a match possible."""
    either = lambda names: reduce(lambda a, b: a | b, [F.col(MARKS)[n] for n in names])
    groups = _IMPLIED.get(signature.regex)
    found = signature_hits(line, signature, F.col(LOW))
    return found if groups is None else F.when(reduce(lambda a, b: a & b, map(either, groups)), found).otherwise(none())


def with_hits(lines: DataFrame, signatures: list[Signature] | None = None, threshold: float = ENTROPY_THRESHOLD, min_length: int = MIN_LENGTH, words: tuple[str, ...] = CONTEXT_WORDS) -> DataFrame:
    """lines that may hold hits, with them as the array column `hits`: signatures first, then entropy."""
    own = signatures is not None
    signatures = default_signatures() if signatures is None else signatures
    quick = not own and words == CONTEXT_WORDS
    lines = marked(lines) if quick else lines.where(F.col("line_content") != "")
    native, other = [s for s in signatures if s.expressible], [s for s in signatures if not s.expressible]
    parts = [marked_hits(F.col("line_content"), s) if quick else signature_hits(F.col("line_content"), s) for s in native]
    if other:
        lines = python_hits(lines, other)
        parts.append(F.col("py_hits"))
    line, told = F.col("line_content"), None
    if quick:
        # of ASCII the folded line is the one in lower case
        words_left = reduce(lambda a, b: a | b, [F.col(MARKS)[w] for w in _LOW_HINTS if w != "://"])
        told = words_left & F.when(F.length(line) == F.octet_length(line), holds(F.col(LOW), words)).otherwise(suspicious(line, words))
    parts.append(entropy_hits(line, threshold, min_length, words, told))
    return bound(lines, hits=F.concat(*parts)).drop("py_hits", LOW, MARKS)


def raw_findings(lines: DataFrame, **options) -> DataFrame:
    """One row per hit of lines (file_path, commit_hash, line_number, line_content, seq); rank orders a line's hits."""
    found = with_hits(lines, **options).select("file_path", "commit_hash", "line_number", "line_content", "seq", F.posexplode("hits").alias("rank", "hit"))
    return found.select(
        F.col("hit.type").alias("detector_type"), F.col("hit.matched_string").alias("matched_string"), "file_path", "line_number", "commit_hash", "line_content",
        F.col("hit.entropy_score").alias("entropy_score"), F.col("hit.start_col").alias("start_col"), F.col("hit.end_col").alias("end_col"), "seq", "rank",
    )
