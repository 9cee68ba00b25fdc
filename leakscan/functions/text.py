"""Column functions on secrets, lines and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plan import let

# Fixed values.
TEST_SEGMENTS = ("test", "tests", "spec", "specs", "example", "examples", "mock", "mocks", "__mocks__", "sample", "samples", "fixture", "fixtures", "testdata", "demo")
CONFIG_EXTENSIONS = (".yml", ".yaml", ".json", ".ini", ".toml", ".cfg", ".conf", ".properties", ".xml", ".env")
SOURCE_EXTENSIONS = (".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".java", ".rb", ".php", ".c", ".cpp", ".cs", ".sh", ".rs", ".kt", ".swift", ".scala", ".pl")
DOC_EXTENSIONS = (".md", ".markdown", ".rst", ".txt")
DOC_NAMES = ("readme", "readme.md", "changelog", "changelog.md")
# Values that stand in for a secret, matched anywhere in it without regard to case.
PLACEHOLDERS = [
    r"your[_\- ]?(api[_\-]?)?(key|token|secret|password)[_\- ]?here",
    r"insert[_\- ].*(key|token|secret)",
    r"replace[_\- ]?me",
    r"change[_\- ]?me",
    r"<[^>]+>",
    r"\{\{.*\}\}",
    r"\$\{[^}]*\}",
    r"os\.environ|os\.getenv|process\.env|getenv\s*\(|System\.getenv",
    "example",
    "placeholder",
    "dummy",
    "redacted",
    "notasecret",
    "^x{4,}$",
    "^0{4,}$",
    "^(foo|bar|baz|qux)+$",
    "^(sk_test_|pk_test_)",
]
# Labels of password forms, matched as a whole.
FORM_LABELS = [
    r"changeme",
    r"change[_-]?password",
    r"new[_-]?password",
    r"reset[_-]?password",
    r"update[_-]?password",
    r"confirm[_-]?password",
    r"current[_-]?password",
    r"old[_-]?password",
    r"password[_-]?(change|reset|update|new|confirm|current|old)",
    r"password[_-]?changed",
]


def slashes(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def characters(value: Column) -> Column:
    """The code points of a string."""
    return F.regexp_extract_all(value, F.lit("(?s)."), 0)


def entropy(value: Column) -> Column:
    """Shannon entropy in bits for each character; 0 for an empty string."""
    # a value has few distinct characters; the length that is left without one tells how often it stands
    letters = F.sort_array(F.array_distinct(F.when(value != "", F.split(value, "")).otherwise(F.array().cast("array<string>"))))
    # in bytes, whose number is known without counting
    gone = lambda c: F.octet_length(value) - F.octet_length(F.replace(value, c, F.lit("")))
    shares = let(F.length(value), lambda n: F.transform(letters, lambda c: gone(c) / (F.octet_length(c) * n)))
    return F.aggregate(shares, F.lit(0.0), lambda s, share: s - share * F.log2(share))


def is_placeholder(secret: Column, extra: tuple[str, ...] = ()) -> Column:
    label = F.lower(F.regexp_replace(secret, r"^\s+|\s+$", "")).rlike(f"^(?:{'|'.join(FORM_LABELS)})$")
    known = secret.rlike("(?i)" + "|".join(f"(?:{p})" for p in PLACEHOLDERS))
    flat = (F.length(secret) >= 8) & (F.size(F.array_distinct(characters(secret))) <= 2)
    found = (F.coalesce(secret, F.lit("")) == "") | label | known | flat
    for p in extra:
        found = found | secret.rlike(f"(?i){p}")
    return found


def redact(secret: Column) -> Column:
    """Keeps up to four leading characters and masks at most twenty more."""
    n = F.length(secret)
    shown = F.when(n > 8, 4).when(n > 3, 1).otherwise(0)
    return F.concat(F.substring(secret, F.lit(1), shown), F.repeat(F.lit("*"), F.least(n - shown, F.lit(20))))


def redact_line(line: Column, secret: Column, mask: Column, start: Column, end: Column) -> Column:
    """The line with the secret masked, trimmed, and then cut to 200 characters."""
    spliced = F.concat(F.substring(line, F.lit(1), start), mask, F.substring(line, end + 1, F.length(line)))
    valid = start.isNotNull() & end.isNotNull() & (start >= 0) & (start < end) & (end <= F.length(line))
    once = F.when(valid, spliced).otherwise(line)
    safe = F.when(secret != "", F.replace(once, secret, mask)).otherwise(once)
    return F.substring(F.regexp_replace(F.coalesce(safe, F.lit("")), r"^\s+|\s+$", ""), 1, 200)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows; leading dots of a name start no extension."""
    return F.regexp_extract(F.lower(base_name(path)), r"^\.*[^.].*?(\.[^.]*)$", 1)


def file_class(path: Column) -> Column:
    lowered = F.lower(slashes(path))
    name, ext = F.lower(base_name(path)), extension(path)
    return (
        F.when(F.arrays_overlap(F.split(lowered, "/"), F.array(*map(F.lit, TEST_SEGMENTS))), "test")
        .when(F.startswith(name, F.lit(".env")), "env")
        .when(name.isin(*DOC_NAMES) | ext.isin(*DOC_EXTENSIONS), "docs")
        .when(ext.isin(*CONFIG_EXTENSIONS), "config")
        .when(ext.isin(*SOURCE_EXTENSIONS), "source")
        .otherwise("other")
    )
