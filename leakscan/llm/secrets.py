"""Secret scans: fixed credential shapes, and name-literal pairs read from source and configuration syntax.

A lexer cuts a text into names, strings (also raw, triple-quoted, with escapes), operators, brackets, line ends, tags and comments.
From the tokens come assignments of a name to an expression:

- name = x, name: x, name => x, name := x, "name": x, conf["name"] = x, with types and keywords around them, keyword arguments;
- bare values of configuration lines (NAME=x, export NAME=x, name: x), also continued by a backslash;
- calls: set_password("x"), put("name", "x"), and the literals in a call that a name is assigned to, but for lookups by name;
- tags: <name>x</name>, <a name="n" value="x"/>, <a name="n">x</a>, and each attribute.

An expression is a concatenation (+, ., .., &, or strings side by side) of literals and names; or, || and ?? part alternatives. A
name stands for its last assignment before it that its scope can see (braces, indented function bodies, sections [x] of
configuration files; else the first one after it). Sensitivity flows from the assigned names along these references to a
fixed point, through chains and cycles; each literal is scored by the most sensitive name that it reaches and by the joined
value that it is a piece of. Comments are read on their own: what they assign is scored, but defines nothing outside; marks of
comments in them are passed over. Calls inside calls count as one value down to NESTED levels; what lies deeper is a value of its own
that the call refers to, and so are constants of over JOINED pieces. So any text, however deeply nested, is read in about the time
of its length.

Nulls and empty texts hold no spans. Rows are scanned one by one, so repeated rows, ids and further columns do not matter. Offsets
are code points, ends exclusive. Of equally sensitive names the one met first is reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices

# The base shapes, in their order.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# How strongly a word in a name says that its value is a secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 0.9, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "private": 0.5, "key": 0.5, "access": 0.3, "signing": 0.4, "encryption": 0.4, "client": 0.1, "api": 0.4, "jwt": 0.6, "bearer": 0.7, "salt": 0.4}
PLACEHOLDER = re.compile(r"(?i)^(?:changeme|change_me|example|placeholder|none|null|true|false|undefined|xxx+|todo|your[_-].*|<.*>|\[.*\]|\$\{.*|\$\w+|\{\{.*|%\(.*|\*+)$")

TOKEN = re.compile(
    r"""(?P<gap>[^\S\r\n]+|\\(?:\r\n?|\n))|(?P<nl>\r\n?|\n)|(?P<comment>/\*|<!--|(?<!\S)(?:\#|//)[^\r\n]*|(?:(?<=[\r\n])|\A)(?:--\ |;)[^\r\n]*)
    |(?P<str>(?<!\w)(?:[rRbBuUfF]{1,2})?(?:\"\"\"|\'\'\'|["'`]))|(?P<name>[A-Za-z_$][\w$]*(?:[.\-][\w$]+)*)|(?P<tag></?(?=[A-Za-z]))
    |(?P<op>:=|=>|->|::|[=!<>]=|\|\||\?\?|\.\.|[=:+,;(){}\[\].&])|(?P<other>[^\s"'`,;:=(){}\[\]<>]+|.)""",
    re.X | re.S | re.A,
)
IN_COMMENT = re.compile(TOKEN.pattern.replace(r"[^\r\n]*|(?:(?<=", "|(?:(?<=", 1).replace(r";)[^\r\n]*)", ";))", 1), TOKEN.flags)  # the mark of a comment only
STRING_END = {q: re.compile(rf"[^{q}\\\r\n]*+(?:\\[\s\S][^{q}\\\r\n]*+)*+{q}") for q in "\"'"} | {"`": re.compile(r"[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`")}
OPEN_TAG = re.compile(r"<([A-Za-z][\w:.\-]*)((?:\s+[\w:.\-]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(/?)>")
ATTRIBUTE = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)')")
ELEMENT_TEXT = re.compile(r"\s*([^<>\s]+)\s*</")
BARE = re.compile(r"[^\S\r\n]*([^\s\"',;#(){}\[\]`]+)[^\S\r\n]*(?=[\r\n]|\Z|(?<=\s)(?:[#;]|//))")
NESTED, JOINED = 4, 64
LINE_END = re.compile(r"\r\n?|\n")
IDENTIFIER = re.compile(r"[A-Za-z_][\w.\-]*")
# Words before an assigned name, types after it, and first words of functions that look a value up by its name.
BEFORE = frozenset("export set setx env arg let var const final static public private protected def val readonly declare local global my our".split())
TYPES = frozenset("str string char bytes text object any wchar_t std.string".split())
LOOKUPS = frozenset("get getenv environ env fetch read load lookup find has is check validate verify delete remove print printf log warn error raise require import include".split())
SEPARATOR = re.compile(r"[=:(<]")
JOINERS = str.maketrans("", "", "_-.$")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@dataclass(frozen=True)
class SecretRules:
    """min_score: least product of the name's and the literal's score; min_length: shortest literal."""

    min_score: float = 0.45
    min_length: int = 6


def name_score(name: str) -> float:
    parts = [p.lower() for p in NAME_PART.findall(name)]
    whole = "".join(parts)
    extra = max((v for k, v in SENSITIVE.items() if len(k) > 5 and k in whole), default=0.0)
    return min(1.0, max(extra, sum(SENSITIVE.get(p, 0.0) for p in set(parts))))


def literal_score(value: str) -> float:
    """0 for placeholders and prose, towards 1 for long values with many different characters."""
    if not value or " " in value or PLACEHOLDER.match(value):
        return 0.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return min(1.0, 0.3 + bits / 6 + min(len(value), 32) / 96)


@dataclass(slots=True)
class Token:
    kind: str  # name, str, op, nl, other
    text: str  # of a string: its value
    start: int  # of a string: of its value
    end: int


@dataclass(slots=True)
class Assignment:
    """name: what is assigned; literals, refs: the pieces of the expression and the names in it; at: place; scope: who sees it."""

    name: str
    literals: list[tuple[int, int]]
    refs: list[str]
    at: int
    scope: int
    own_line: tuple[int, int] | None = None  # the bare word that a lone name on a configuration line may be


class Lexer:
    """Assignments of one text (or one comment)."""

    def __init__(self, text: str, start: int = 0, end: int | None = None, comment: bool = False) -> None:
        self.text, self.start, self.end, self.comment = text, start, len(text) if end is None else end, comment
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []
        self.found: list[Assignment] = []
        self.deep: dict[int, bool] = {}
        self.tags: list[re.Match] = []
        self.tokenize()
        self.match_brackets()

    def tokenize(self) -> None:
        text, at, end, out, never = self.text, self.start, self.end, self.tokens, set()
        token = (IN_COMMENT if self.comment else TOKEN).match
        while at < end:
            m = token(text, at, end)
            kind, a, at = m.lastgroup, at, m.end()
            if kind == "gap":
                continue
            if kind == "comment" and self.comment:
                continue
            if kind == "comment":
                if m[0] in ("/*", "<!--"):
                    mark = "*/" if m[0] == "/*" else "-->"
                    stop = -1 if mark in never else text.find(mark, at, end)
                    if stop < 0:
                        never.add(mark)
                        continue
                    self.comments.append((at, stop))
                    at = stop + len(mark)
                else:
                    self.comments.append((a + (2 if m[0][:2] in ("//", "--") else 1), at))
            elif kind == "str":
                quote = m[0].lstrip("rRbBuUfF")
                if len(quote) == 3:
                    stop = -1 if quote in never else text.find(quote, at, end)
                    if stop < 0:
                        never.add(quote)
                        continue
                    out.append(Token("str", text[at:stop], at, stop))
                    at = stop + 3
                elif quote not in never:
                    e = STRING_END[quote].match(text, at, end)
                    if e:
                        out.append(Token("str", text[at : e.end() - 1], at, e.end() - 1))
                        at = e.end()
                    elif quote == "`":
                        never.add(quote)
            elif kind == "tag":
                t = OPEN_TAG.match(text, a, end)
                if t:
                    self.tags.append(t)
                    at = t.end()
            else:
                out.append(Token(kind, m[0], a, at))

    def match_brackets(self) -> None:
        """The place of each bracket's partner, and the scope and bracket depth of each token. Scopes are numbered as they open;
        self.last has the last scope inside each."""
        self.partner: dict[int, int] = {}
        self.scopes: list[int] = []
        self.last: list[int] = [0]
        stack: list[int] = []
        scope: list[tuple[int, int]] = []  # (number, indent; -1: a brace; -2: a section)
        fresh, body, self.inside = True, None, []
        line = seen = 0  # where the line of the last place looked at begins, and that place
        pairs = {")": "(", "]": "[", "}": "{"}

        def opened(kind: int) -> None:
            scope.append((len(self.last), kind))
            self.last.append(-1)

        def closed() -> int:
            n, kind = scope.pop()
            self.last[n] = len(self.last) - 1
            return kind

        for i, t in enumerate(self.tokens):
            if fresh and t.kind != "nl" and not stack:
                line, seen = max(line, 1 + self.text.rfind("\n", seen, t.start), 1 + self.text.rfind("\r", seen, t.start)), t.start
                indent = t.start - line
                while scope and (0 <= scope[-1][1] and indent <= scope[-1][1]):
                    closed()
                section = t.text == "[" and i + 2 < len(self.tokens) and self.tokens[i + 2].text == "]" and (i + 3 == len(self.tokens) or self.tokens[i + 3].kind == "nl")
                if section and (not scope or scope[-1][1] == -2):
                    while scope:
                        closed()
                    opened(-2)
                body = indent if t.text in ("def", "class", "async") else None
            fresh = t.kind == "nl"
            if fresh and body is not None and not stack:
                opened(body)
                body = None
            self.scopes.append(scope[-1][0] if scope else 0)
            self.inside.append(len(stack))
            if t.kind == "op":
                if t.text in "([{":
                    stack.append(i)
                    if t.text == "{":
                        opened(-1)
                elif t.text in pairs and stack and self.tokens[stack[-1]].text == pairs[t.text]:
                    self.partner[stack.pop()] = i
                    if t.text == "}":
                        while scope and closed() != -1:
                            pass
        while scope:
            closed()
        self.last[0] = len(self.last) - 1

    def is_op(self, i: int, *ops: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "op" and self.tokens[i].text in ops

    def past_lines(self, i: int) -> int:
        while i < len(self.tokens) and self.tokens[i].kind == "nl":
            i += 1
        return i

    def expression(self, i: int) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
        """The alternatives of the expression at token i: pieces and names. What stands in brackets is one operand."""
        literals: list[tuple[int, int]] = []
        refs: list[str] = []
        tokens, n = self.tokens, len(self.tokens)
        ends: list[int] = []  # of the brackets that i is in
        i = self.past_lines(i) if i < n and self.inside[i] else i
        while True:
            t = tokens[i] if i < n else None
            operand = True
            if t is None:
                operand = False
            elif t.kind == "str":
                literals.append((t.start, t.end))
                i += 1
            elif t.kind == "name" and t.text in ("new", "await", "return"):
                i += 1
                continue
            elif t.kind == "name" and self.is_op(i + 1, "("):
                operand = i + 1 in self.partner
                if operand:
                    for arg in self.arguments(i + 1, skip_key=looks_up(t.text)):
                        literals += [(x.start, x.end) for x in arg if x.kind == "str"]
                        refs += [x.text for x in arg if x.kind == "name"]
                    i = self.partner[i + 1] + 1
            elif t.kind == "name":
                if t.text != "or":
                    refs.append(t.text)
                i += 1
            elif self.is_op(i, "(") and i in self.partner:
                ends.append(self.partner[i])
                i = self.past_lines(i + 1)
                continue
            else:
                operand = False
            while True:
                after = i if i >= n or tokens[i].kind != "nl" else self.past_lines(i)
                if operand and after < n and (tokens[after].text in ("||", "??") or (tokens[after].kind == "name" and tokens[after].text == "or")) and (after == i or self.inside[after]):
                    if not ends:
                        yield literals, refs
                        literals, refs = [], []
                    i = self.past_lines(after + 1)
                elif operand and self.is_op(after, "+", ".", "..", "&"):
                    i = self.past_lines(after + 1)
                elif operand and after < n and tokens[after].kind == "str" and tokens[i - 1].kind == "str" and (after == i or self.inside[after]):
                    i = after  # strings side by side
                elif ends:
                    i, operand = ends.pop() + 1, True
                    continue
                else:
                    if literals or refs:
                        yield literals, refs
                    return
                break

    def arguments(self, i: int, skip_key: bool = False) -> list[list[Token]]:
        """The arguments of the call whose bracket is token i, calls in it included, but for lookups, other
        brackets and named arguments. Calls more than NESTED levels deep are references."""
        out: list[list[Token]] = [[]]
        named, j, end = False, i + 1, self.partner[i]
        ends: list[int] = []
        while j < end:
            t = self.tokens[j]
            while ends and j >= ends[-1]:
                ends.pop()
            if self.is_op(j, ","):
                out.append([])
                named = False
            elif self.is_op(j, "=", ":", "=>"):
                out[-1], named = [], True
            elif t.kind in ("str", "name") and not named:
                out[-1].append(t)
            nested = self.is_op(j, "(") and not (self.tokens[j - 1].kind == "name" and looks_up(self.tokens[j - 1].text))
            if nested and j in self.partner and len(ends) >= NESTED:
                if not named:
                    out[-1].append(Token("name", self.deeper(j), t.start, t.start))
                nested = False
            elif nested and j in self.partner:
                ends.append(self.partner[j])
            j = j + 1 if nested else self.partner.get(j, j) + 1
        return out[1:] if skip_key else out

    def deeper(self, i: int) -> str:
        """The name that stands for the arguments of the call whose bracket is token i."""
        if i not in self.deep:
            self.deep[i] = False  # not read yet
        return f"\0{i}"

    def assign(self, name: str, i: int, literals: list[tuple[int, int]], refs: list[str], own_line: tuple[int, int] | None = None) -> None:
        scope = self.scopes[i] if i < len(self.scopes) else 0
        self.found.append(Assignment(name, literals, refs, self.tokens[i].start if i < len(self.tokens) else 0, scope, own_line))

    def target(self, i: int) -> int | None:
        """The token that the operator i assigns to."""
        j = i - 1
        if self.is_op(j, "]") and self.is_op(j - 2, "[") and self.tokens[j - 1].kind == "str":
            return j - 1
        if j < 0 or self.tokens[j].kind not in ("name", "str"):
            return None
        if self.tokens[i].text == "=" and self.tokens[j].kind == "name" and j:
            if self.is_op(j - 1, ":") and j > 1 and self.tokens[j - 2].kind == "name":
                return j - 2  # a name with its type
            if self.tokens[j].text.lower() in TYPES and self.tokens[j - 1].kind == "name":
                return j - 1
        return j

    def starts_line(self, j: int) -> bool:
        """Whether token j is a line's first, but for words like export."""
        j -= 1
        while j >= 0 and self.tokens[j].kind == "name" and self.tokens[j].text.lower() in BEFORE:
            j -= 1
        return j < 0 or self.tokens[j].kind == "nl" or (self.tokens[j].text == "-" and (j == 0 or self.tokens[j - 1].kind == "nl"))

    def bare(self, at: int) -> list[tuple[int, int]]:
        """The bare value of a configuration line from `at` on, with its continued lines."""
        out = []
        while m := BARE.match(self.text, at, self.end):
            more = m[1].endswith("\\") and m.end() == m.end(1)
            out.append((m.start(1), m.end(1) - more))
            line = LINE_END.match(self.text, m.end(), self.end) if more else None
            if not line:
                break
            at = line.end()
        return out

    def assignments(self) -> list[Assignment]:
        tokens = self.tokens
        for i, t in enumerate(tokens):
            if t.kind == "name" and self.is_op(i + 1, "(") and i + 1 in self.partner:
                sensitive = name_score(t.text) and not looks_up(t.text)
                # name("key", ...): only such calls and those of sensitive functions are read here
                keyed = i + 3 < len(tokens) and tokens[i + 2].kind == "str" and self.is_op(i + 3, ",") and not looks_up(t.text)
                args = self.arguments(i + 1) if sensitive or keyed else []
                if sensitive:
                    self.assign(t.text, i, [(x.start, x.end) for arg in args for x in arg if x.kind == "str"], [x.text for arg in args for x in arg if x.kind == "name"])
                key = args[0][0] if len(args) > 1 and len(args[0]) == 1 and args[0][0].kind == "str" else None
                if key and IDENTIFIER.fullmatch(key.text) and not looks_up(t.text):
                    self.assign(key.text, i, [(x.start, x.end) for x in args[1] if x.kind == "str"], [x.text for x in args[1] if x.kind == "name"])
            if t.kind != "op" or t.text not in ("=", ":", ":=", "=>") or i + 1 >= len(tokens):
                continue
            j = self.target(i)
            if j is None:
                continue
            name = tokens[j].text
            pieces = self.bare(t.end) if self.starts_line(j) and not self.inside[j] else []
            if len(pieces) == 1 and IDENTIFIER.fullmatch(self.text, *pieces[0]):
                self.assign(name, j, [], [self.text[slice(*pieces[0])]], pieces[0])
            elif pieces:
                self.assign(name, j, pieces, [])
            else:
                for literals, refs in self.expression(i + 1):
                    self.assign(name, j, literals, refs)
        for m in self.tags:
            held = {a[1].lower(): a.span(2) if a[2] is not None else a.span(3) for a in ATTRIBUTE.finditer(m[2])}
            held = {k: (x + m.start(2), y + m.start(2)) for k, (x, y) in held.items()}
            called = [self.text[slice(*held[k])] for k in ("name", "key", "id") if k in held]
            inner = None if m[3] else ELEMENT_TEXT.match(self.text, m.end(), self.end)
            values = [(k, v) for k, v in held.items()] + [(c, held["value"]) for c in called if "value" in held] + ([(c, inner.span(1)) for c in [m[1], *called]] if inner else [])
            self.found += [Assignment(name, [span], [], m.start(), 0) for name, span in values]
        while todo := [i for i, read in self.deep.items() if not read]:
            for i in todo:
                self.deep[i] = True
                held = [x for arg in self.arguments(i) for x in arg]
                self.found.append(Assignment(f"\0{i}", [(x.start, x.end) for x in held if x.kind == "str"], [x.text for x in held if x.kind == "name"], tokens[i].start, 0))
        return self.found


def looks_up(function: str) -> bool:
    """Whether a function's name says that its first argument is the name of a value, or that its result is none."""
    words = [w.lower() for w in NAME_PART.findall(function.rsplit(".", 1)[-1])]
    return bool(words) and words[0] in LOOKUPS


def resolved(found: list[Assignment], last: list[int]) -> list[list[int]]:
    """For each assignment the numbers of those that its names stand for; last: of each scope the last one inside it.

    Assignments come in the order of their places, so those of a name in scopes that are open form a stack, the innermost on
    top; what has been closed is taken off when it is met. One pass forwards finds the last assignment before a place, one
    backwards the first one after it."""
    before: list[dict[str, int]] = []
    after: list[dict[str, int]] = [{}] * len(found)
    for way, numbers in ((before, range(len(found))), (after, reversed(range(len(found))))):
        open_: dict[str, list[tuple[int, int]]] = {}

        def top(name: str, scope: int, open_: dict = open_) -> list[tuple[int, int]]:
            held = open_.get(name, [])
            while held and not held[-1][0] <= scope <= last[held[-1][0]]:
                held.pop()
            return held

        for k in numbers:
            x = found[k]
            met = {ref: held[-1][1] for ref in dict.fromkeys(x.refs) if (held := top(ref, x.scope))}
            if way is before:
                before.append(met)
            else:
                after[k] = met
            held = top(x.name, x.scope)
            if held and held[-1][0] == x.scope:
                held.pop()
            open_.setdefault(x.name, held).append((x.scope, k))
    return [[hit for ref in dict.fromkeys(x.refs) if (hit := b.get(ref, a.get(ref))) is not None] for x, b, a in zip(found, before, after, strict=True)]


def scored(text: str, found: list[Assignment], last: list[int], rules: SecretRules) -> dict[tuple[int, int], tuple[float, str]]:
    """The best score and name of each literal that reaches a sensitive name."""
    uses = resolved(found, last)
    weight = [(name_score(x.name), x.name) for x in found]
    # the most sensitive first, so that each assignment is settled once
    todo = sorted((k for k in range(len(found)) if weight[k][0]), key=lambda k: -weight[k][0])
    settled = [False] * len(found)
    for top in todo:
        chain = [top]
        while chain:
            k = chain.pop()
            if settled[k]:
                continue
            settled[k] = True
            weight[k] = max(weight[k], weight[top], key=lambda w: w[0])
            chain += [u for u in uses[k] if not settled[u]]
    out: dict[tuple[int, int], tuple[float, str]] = {}
    for k, x in enumerate(found):
        w, name = weight[k]
        if not w:
            continue
        pieces = x.literals + [p for u in uses[k] if len(found[u].literals) <= JOINED for p in found[u].literals]
        if not pieces and x.own_line and not uses[k]:
            pieces = [x.own_line]  # a name that leads nowhere is a value itself
        value = "".join(text[a:b] for a, b in pieces)
        score = w * literal_score(value)
        if len(value) >= rules.min_length and score >= rules.min_score:
            for p in pieces:
                if p[1] > p[0] and score > out.get(p, (0.0, ""))[0]:
                    out[p] = (score, name)
    return out


def lexed(text: str, rules: SecretRules) -> list[tuple[str, int, int, str, float]]:
    """Spans of literals that reach a sensitive name: (literal, start, end, name, score)."""
    out: dict[tuple[int, int], tuple[float, str]] = {}
    todo: list[tuple[int, int, bool]] = [(0, len(text), False)]
    while todo:
        lexer = Lexer(text, *todo.pop())
        todo += [(*x, True) for x in lexer.comments]
        for span, best in scored(text, lexer.assignments(), lexer.last, rules).items():
            if best[0] > out.get(span, (0.0, ""))[0]:
                out[span] = best
    return [("literal", a, b, name, score) for (a, b), (score, name) in out.items()]


def may_name(low: str) -> bool:
    """Whether a lower-cased text holds any sensitive word, joiners left out."""
    bare = low.translate(JOINERS)
    return any(w in bare for w in SENSITIVE)


def scan_text(text: str, rules: SecretRules = SecretRules()) -> list[tuple[str, int, int, str, float]]:
    """All spans of a text, by start, then by kind."""
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        out += [("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if SEPARATOR.search(text) and may_name(low):
        out += lexed(text, rules)
    if "AKIA" in text:
        out += [("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, name, score), one row per row of docs."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "name", "score"), x, strict=True)) for x in scan_text(t or "", rules)] for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": found})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(scan, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, name: string, score: double>>")


def redact_secrets(docs: DataFrame, mask: str = "[secret]", rules: SecretRules = SecretRules()) -> DataFrame:
    """docs with every found span replaced by the mask (overlapping spans by one) and n_chars counted anew; other columns stay."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (some for whole in batches for some in slices(whole)):
            old = b["text"].to_pylist()
            new = [None if t is None else masked(t, scan_text(t, rules), mask) for t in old]
            cols = {n: c for n, c in zip(b.schema.names, b.columns, strict=True)} | {"text": pa.array(new, b.schema.field("text").type)}
            if "n_chars" in cols:
                kept = b["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(new, kept, strict=True)], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(lean(clean), docs.schema)


def masked(text: str, spans: list[tuple], mask: str) -> str:
    out, at = [], 0
    for _, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def span_digests(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """One row per row of docs: counts of the base kinds, sha256 of the base spans, and all spans as text."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [scan_text(t or "", rules) for t in b["text"]]
            count = lambda kind: [sum(x[0] == kind for x in r) for r in rows]  # noqa: E731, B023
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
                "base_sha256": [hashlib.sha256(joined([x for x in r if x[0] != "literal"]).encode()).hexdigest() for r in rows],
                "spans": [joined(r) for r in rows],
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(digest, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
