"""The signature library, and the translation of its regular expressions to Spark's dialect."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

# Type, description, expression, flags. The group named `value`, where there is one, is the secret.
SIGNATURES = [
    ("AWS_ACCESS_KEY", "AWS Access Key ID", r"AKIA[0-9A-Z]{16}", ()),
    ("AWS_SECRET_KEY", "AWS Secret Access Key assigned to a recognizable variable name", r"""(?:aws_secret_access_key|aws_secret_key|secret_access_key)\s*[:=]\s*['"](?P<value>[A-Za-z0-9/+=]{40})['"]""", ("IGNORECASE",)),
    ("GENERIC_API_KEY", "Generic api_key/apikey style assignment", r"""(?:api[_-]?key|apikey)\s*[:=]\s*['"](?P<value>[A-Za-z0-9\-_]{16,})['"]""", ("IGNORECASE",)),
    ("GENERIC_SECRET", "Generic secret/token style assignment", r"""(?:secret|token|access[_-]?token)\s*[:=]\s*['"](?P<value>[A-Za-z0-9\-_./+=]{12,})['"]""", ("IGNORECASE",)),
    ("GENERIC_PASSWORD", "Generic password assignment (real credential-style value, not a sentence)", r"""(?:password|passwd|pwd)\s*[:=]\s*['"](?P<value>[^\s'"]{4,64})['"]""", ("IGNORECASE",)),
    ("SLACK_TOKEN", "Slack API token", r"xox[baprs]-[0-9A-Za-z-]{10,48}", ()),
    ("SLACK_WEBHOOK", "Slack incoming webhook URL", r"https://hooks\.slack\.com/services/T[0-9A-Za-z_]{8,}/B[0-9A-Za-z_]{8,}/[0-9A-Za-z_]{24}", ()),
    ("PRIVATE_KEY_HEADER", "PEM-format private key header", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", ()),
    ("DB_CONNECTION_STRING", "Database connection string with embedded credentials", r"""(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s'"]+:[^\s'"@]+@[^\s'"/]+""", ("IGNORECASE",)),
    ("JWT", "JSON Web Token (header.payload.signature)", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", ()),
    ("GITHUB_TOKEN", "GitHub personal access / app token", r"gh[pousr]_[A-Za-z0-9]{36}", ()),
    ("GOOGLE_API_KEY", "Google API key", r"AIza[0-9A-Za-z\-_]{35}", ()),
    ("STRIPE_KEY", "Stripe live secret key", r"sk_live_[0-9a-zA-Z]{24,}", ()),
]
# What blank means to a Unicode-aware \s, for an engine whose own \s is ASCII.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FLAGS = {"IGNORECASE": "iu", "MULTILINE": "m", "DOTALL": "s"}
#: Every built-in signature's match holds one of these; lines without any are skipped.
HINTS = r"(?iu)key|token|secret|passw|pwd|auth|credential|akia|xox|hooks\.slack|://|eyj|gh[pousr]_|aiza|sk_live_"
#: Of each built-in signature, literals of which every match holds one: in lower case for those that ignore case.
NEEDED = dict(zip((s[2] for s in SIGNATURES), (
    ("AKIA",), ("secret_access_key", "aws_secret_key"), ("api_key", "api-key", "apikey"), ("token", "secret"), ("password", "passwd", "pwd"), ("xox",), ("hooks.slack",), ("-----BEGIN ",),
    ("://",), ("eyJ",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("AIza",), ("sk_live_",),
), strict=True))
#: What the JVM's (?iu) takes for a letter beyond its two cases.
FOLDS = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


class PatternError(ValueError):
    """A signature file that cannot be used."""


@dataclass(frozen=True)
class Signature:
    type: str
    description: str
    regex: str  # as given
    flags: tuple[str, ...] = ()

    @property
    def native(self) -> str:
        """The expression in Spark's dialect, with the value group as a plain one."""
        inline = "".join(FLAGS[f] for f in self.flags)
        return (f"(?{inline})" if inline else "") + spark_regex(self.regex)

    @property
    def group(self) -> int:
        return re.compile(self.regex).groupindex.get("value", 0)

    @property
    def tail(self) -> int | None:
        """Characters of a match after its value; None where that is not fixed."""
        if not self.group:
            return 0
        after = self.regex[_close(self.regex, self.regex.index("(?P<value>")) + 1 :]
        if not after:
            return 0
        return 1 if re.fullmatch(r"\\?.|\[[^\]]+\]", after) else None

    @property
    def expressible(self) -> bool:
        """Whether spans follow from the matches alone: no look-around, anchors, word edges, atomic or possessive parts, and a fixed tail."""
        return self.tail is not None and not re.search(r"\(\?[=!<>](?!P)|[*+?}]\+|\\[bBAZ]|(?<![\[\\])[\^$]|\\\d", self.regex.replace("(?P<value>", "(")) and not re.match(self.regex, "")


def _close(regex: str, at: int) -> int:
    """Index of the bracket that closes the group opened at `at`."""
    depth, inside, i = 0, False, at
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            i += regex[i + 1 : i + 2] == "]" or 2 * (regex[i + 1 : i + 3] == "^]")
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
        i += 1
    raise PatternError(f"unbalanced group in {regex}")


def spark_regex(regex: str) -> str:
    """Widens \\s to Unicode blanks, and turns named groups into plain ones."""
    out, inside, i = [], False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\" and i + 1 < len(regex):
            if regex[i + 1] == "s":
                out.append(BLANK if inside else f"[{BLANK}]")
            else:
                out.append(regex[i : i + 2])
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif regex.startswith("(?P<", i):
            out.append("(")
            i = regex.index(">", i) + 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def begun(regex: str, firsts: str) -> str:
    """The same search, told by which characters (letters in either case) all its matches begin: most places fail at one test of a set."""
    flags = re.match(r"\(\?[a-z]+\)|", regex)[0]
    either = "".join(sorted({x for c in firsts for x in (c.lower(), c.upper(), *FOLDS.get(c.lower(), ""))}))
    return f"(?=[{re.escape(either)}]){flags}(?:{regex[len(flags) :]})"


def quick_blanks(regex: str) -> str:
    """The same expression for the JVM, whose sets try their parts one by one: printable ASCII is settled by a range."""
    free = "".join(f"\\x{a:02x}-\\x{b:02x}" for a, b in ((0x3C, 0x7E), (0x2D, 0x3A), (0x24, 0x2B), (0x21, 0x22)))  # all but , ; and #
    regex = regex.replace(f"[^{BLANK},;#]", f"[{free}[^{BLANK},;#]]")
    return regex.replace(f"[{BLANK}]", rf"[\x00-\x20\x7f-\x{{10ffff}}&&[{BLANK}]]")


def default_signatures() -> list[Signature]:
    return [Signature(*s) for s in SIGNATURES]


def load_signatures(path: str | None = None) -> list[Signature]:
    """Signatures from a JSON array of {type, description, regex, flags}; the built-in ones without a path."""
    if path is None:
        return default_signatures()
    try:
        with open(path, encoding="utf-8") as f:
            rows = json.load(f)
    except FileNotFoundError as e:
        raise PatternError(f"no pattern file at {path}") from e
    except json.JSONDecodeError as e:
        raise PatternError(f"{path} is not JSON: {e}") from e
    if not isinstance(rows, list):
        raise PatternError(f"{path} is not a list")
    out = []
    for n, row in enumerate(rows):
        if not isinstance(row, dict) or not row.get("type") or not row.get("regex"):
            raise PatternError(f"entry {n} of {path} needs type and regex")
        flags = tuple(str(x).upper() for x in row.get("flags", ()))
        if unknown := set(flags) - set(FLAGS):
            raise PatternError(f"unknown flags {sorted(unknown)} in {row['type']}")
        try:
            re.compile(row["regex"])
        except re.error as e:
            raise PatternError(f"bad regex in {row['type']}: {e}") from e
        out.append(Signature(row["type"], row.get("description") or row["type"], row["regex"], flags))
    return out
