"""DuckDB SQL of the engine's stages, each a common table expression that builds on those before."""

from __future__ import annotations

from .corpus import CORPUS_SQL

# Fixed values, written out here a second time, so that a wrong one in the library shows as a difference.
SIGNATURES = (
    ('AWS_ACCESS_KEY', 'AKIA[0-9A-Z]{16}', False),
    ('AWS_SECRET_KEY', '(?:aws_secret_access_key|aws_secret_key|secret_access_key)\\s*[:=]\\s*[\'"](?P<value>[A-Za-z0-9/+=]{40})[\'"]', True),
    ('GENERIC_API_KEY', '(?:api[_-]?key|apikey)\\s*[:=]\\s*[\'"](?P<value>[A-Za-z0-9\\-_]{16,})[\'"]', True),
    ('GENERIC_SECRET', '(?:secret|token|access[_-]?token)\\s*[:=]\\s*[\'"](?P<value>[A-Za-z0-9\\-_./+=]{12,})[\'"]', True),
    ('GENERIC_PASSWORD', '(?:password|passwd|pwd)\\s*[:=]\\s*[\'"](?P<value>[^\\s\'"]{4,64})[\'"]', True),
    ('SLACK_TOKEN', 'xox[baprs]-[0-9A-Za-z-]{10,48}', False),
    ('SLACK_WEBHOOK', 'https://hooks\\.slack\\.com/services/T[0-9A-Za-z_]{8,}/B[0-9A-Za-z_]{8,}/[0-9A-Za-z_]{24}', False),
    ('PRIVATE_KEY_HEADER', '-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----', False),
    ('DB_CONNECTION_STRING', '(?:postgres(?:ql)?|mysql|mongodb(?:\\+srv)?|redis)://[^\\s\'"]+:[^\\s\'"@]+@[^\\s\'"/]+', True),
    ('JWT', 'eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+', False),
    ('GITHUB_TOKEN', 'gh[pousr]_[A-Za-z0-9]{36}', False),
    ('GOOGLE_API_KEY', 'AIza[0-9A-Za-z\\-_]{35}', False),
    ('STRIPE_KEY', 'sk_live_[0-9a-zA-Z]{24,}', False),
)
CONTEXT_WORDS = (
    'key', 'token', 'secret', 'password', 'passwd', 'pwd', 'auth', 'credential',
)
COMMON_WORDS = (
    'password', 'changeme', 'change_me', 'example', 'placeholder', 'development', 'production', 'localhost', 'administrator', 'username', 'letmein',
    'temporary', 'undefined', 'notasecret', 'testing', 'hunter2',
)
TEST_SEGMENTS = (
    'test', 'tests', 'spec', 'specs', 'example', 'examples', 'mock', 'mocks', '__mocks__', 'sample', 'samples', 'fixture', 'fixtures', 'testdata',
    'demo',
)
CONFIG_EXTENSIONS = (
    '.yml', '.yaml', '.json', '.ini', '.toml', '.cfg', '.conf', '.properties', '.xml', '.env',
)
SOURCE_EXTENSIONS = (
    '.py', '.js', '.ts', '.jsx', '.tsx', '.go', '.java', '.rb', '.php', '.c', '.cpp', '.cs', '.sh', '.rs', '.kt', '.swift', '.scala', '.pl',
)
DOC_EXTENSIONS = (
    '.md', '.markdown', '.rst', '.txt',
)
DOC_NAMES = (
    'readme', 'readme.md', 'changelog', 'changelog.md',
)
PLACEHOLDERS = (
    'your[_\\- ]?(api[_\\-]?)?(key|token|secret|password)[_\\- ]?here', 'insert[_\\- ].*(key|token|secret)', 'replace[_\\- ]?me', 'change[_\\- ]?me',
    '<[^>]+>', '\\{\\{.*\\}\\}', '\\$\\{[^}]*\\}', 'os\\.environ|os\\.getenv|process\\.env|getenv\\s*\\(|System\\.getenv', 'example', 'placeholder',
    'dummy', 'redacted', 'notasecret', '^x{4,}$', '^0{4,}$', '^(foo|bar|baz|qux)+$', '^(sk_test_|pk_test_)',
)
FORM_LABELS = (
    'changeme', 'change[_-]?password', 'new[_-]?password', 'reset[_-]?password', 'update[_-]?password', 'confirm[_-]?password',
    'current[_-]?password', 'old[_-]?password', 'password[_-]?(change|reset|update|new|confirm|current|old)', 'password[_-]?changed',
)
LOOKUPS = '(?i)os\\.environ|os\\.getenv|\\bgetenv\\s*\\(|process\\.env\\b|\\bENV\\s*\\[|System\\.getenv|\\$\\{[^}]*\\}|\\{\\{[^}]*\\}\\}|<%=?[^%]*%>'
MIN_LENGTH, ENTROPY_THRESHOLD, DEFAULT_POINTS = 12, 3.5, 25
BASE_POINTS = {
    50: ('AWS_ACCESS_KEY', 'AWS_SECRET_KEY', 'PRIVATE_KEY_HEADER', 'DB_CONNECTION_STRING', 'STRIPE_KEY', 'GITHUB_TOKEN', 'GOOGLE_API_KEY'),
    35: ('SLACK_TOKEN', 'SLACK_WEBHOOK', 'GENERIC_API_KEY', 'JWT'),
    20: ('GENERIC_SECRET', 'GENERIC_PASSWORD', 'HIGH_ENTROPY'),
}
CLASS_POINTS = {
    'env': (15, 'in a .env file (+15)'),
    'config': (10, 'in a config file (+10)'),
    'source': (5, 'in source code (+5)'),
    'test': (-20, 'in a test/example path (-20)'),
    'docs': (-25, 'in docs/markdown (-25)'),
}
BANDS = ((45, 4), (30, 3), (15, 2))


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(text(v) for v in values)


def chars(v: str) -> str:
    return f"string_split({v}, '')"


def entropy(v: str) -> str:
    n = f"(len(list_filter({chars(v)}, lambda y: y = c)) / len({chars(v)}))"
    return f"list_sum(list_transform(list_distinct({chars(v)}), lambda c: -{n} * log2({n})))"


ASSIGN = r"""['"]?([A-Za-z_][A-Za-z0-9_\-]{1,60})['"]?\s*[:=]\s*(?:'([^']*)'|"([^"]*)"|([^\s,;#]+))"""
QUOTED = r"""'([^']*)'|"([^"]*)\""""
CONTEXT = "|".join(CONTEXT_WORDS)
BASE = "CASE " + " ".join(f"WHEN detector_type IN ({listed(kinds)}) THEN {p}" for p, kinds in BASE_POINTS.items()) + f" ELSE {DEFAULT_POINTS} END"


def _starts(regex: str, groups: int, extra: str = "") -> str:
    """Rows (i, at, full, g1..) of all matches of regex in line_content."""
    p = text(regex)
    parts = ", ".join(f"regexp_extract_all(line_content, {p}, {g}) AS l{g}" for g in range(groups + 1))
    cols = ", ".join(f"coalesce(l{g}[i], '') AS g{g}" for g in range(groups + 1))
    return f"""SELECT *, {cols}, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(l0[1:i - 1], lambda x: length(x))), 0))::INTEGER AS spot FROM (
  SELECT *, unnest(range(1, len(l0) + 1)) AS i FROM (SELECT *, {parts}, string_split_regex(line_content, {p}) AS gaps FROM lines WHERE line_content <> ''{extra}))"""


def signature_sql(n: int) -> str:
    kind, regex, flags = SIGNATURES[n]
    valued = "(?P<value>" in regex
    regex = ("(?i)" if flags else "") + regex.replace("(?P<value>", "(")
    v, at = ("g1", "spot + length(g0) - 1 - length(g1)") if valued else ("g0", "spot")
    return f"SELECT file_path, commit_hash, line_number, line_content, seq, {n} AS det, i, '{kind}' AS detector_type, {v} AS matched_string, ({at})::INTEGER AS start_col, ({at} + length({v}))::INTEGER AS end_col, NULL::DOUBLE AS entropy_score FROM ({_starts(regex, 1 if valued else 0)})"


REJECT = f"""(length(value) < {MIN_LENGTH} OR regexp_full_match(value, '[0-9]+') OR regexp_full_match(value, '#?[0-9A-Fa-f]{{3}}(?:[0-9A-Fa-f]{{3}})?')
  OR regexp_full_match(value, '[0-9A-Fa-f]{{8}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{4}}-[0-9A-Fa-f]{{12}}') OR regexp_matches(value, {text(LOOKUPS)})
  OR regexp_matches(value, '\\s') OR lower(value) IN ({listed(COMMON_WORDS)}))"""
PLACEHOLDER = f"""(matched_string = '' OR regexp_full_match(lower(trim(matched_string)), {text("|".join(FORM_LABELS))}) OR regexp_matches(matched_string, {text("(?i)" + "|".join(f"(?:{p})" for p in PLACEHOLDERS))})
  OR (length(matched_string) >= 8 AND len(list_distinct({chars("matched_string")})) <= 2))"""
NAME = "lower(string_split(replace(file_path, chr(92), '/'), '/')[-1])"
EXT = f"regexp_extract({NAME}, '^\\.*[^.].*?(\\.[^.]*)$', 1)"
FILE_CLASS = f"""CASE WHEN len(list_intersect(string_split(lower(replace(file_path, chr(92), '/')), '/'), [{listed(TEST_SEGMENTS)}])) > 0 THEN 'test' WHEN {NAME} LIKE '.env%' THEN 'env'
  WHEN {NAME} IN ({listed(DOC_NAMES)}) OR {EXT} IN ({listed(DOC_EXTENSIONS)}) THEN 'docs' WHEN {EXT} IN ({listed(CONFIG_EXTENSIONS)}) THEN 'config' WHEN {EXT} IN ({listed(SOURCE_EXTENSIONS)}) THEN 'source' ELSE 'other' END"""
SHOWN = "CASE WHEN length(matched_string) > 8 THEN 4 WHEN length(matched_string) > 3 THEN 1 ELSE 0 END"
REDACT = f"substr(matched_string, 1, {SHOWN}) || repeat('*', least(length(matched_string) - {SHOWN}, 20))"
NUM = "regexp_replace(printf('%.2f', entropy_score), '(\\.\\d)0$', '\\1')"

LAYERS = {
    "lines": CORPUS_SQL,
    "signatures": "signatures AS (" + "\n UNION ALL ".join(signature_sql(n) for n in range(len(SIGNATURES))) + ")",
    "pairs": f"""pairs AS (SELECT *, g1 AS name, g2 || g3 || g4 AS value, (spot + length(g0) - CASE WHEN g4 <> '' THEN length(g4) ELSE length(g2) + length(g3) + 1 END)::INTEGER AS at_ FROM ({_starts(ASSIGN, 4)}))""",
    "quotes": f"""quotes AS (SELECT *, g1 || g2 AS value, spot + 1 AS at_ FROM ({_starts(QUOTED, 2, f" AND regexp_matches(lower(line_content), '{CONTEXT}')")}))""",
    "entropic": f"""entropic AS (
  SELECT file_path, commit_hash, line_number, line_content, seq, 100 AS det, i, value, at_ FROM pairs WHERE regexp_matches(lower(name), '{CONTEXT}')
  UNION ALL SELECT file_path, commit_hash, line_number, line_content, seq, 101 AS det, i, value, at_ FROM quotes q WHERE NOT regexp_matches(value, '^(?:/|\\./|\\.\\./|https?://)')
    AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.file_path = q.file_path AND p.seq = q.seq AND ((p.at_ <= q.at_ AND q.at_ < p.at_ + length(p.value)) OR (p.at_ < q.at_ + length(q.value) AND q.at_ + length(q.value) <= p.at_ + length(p.value))))),
entropy_hits AS (
  SELECT * EXCLUDE (value, at_), 'HIGH_ENTROPY' AS detector_type, value AS matched_string, at_::INTEGER AS start_col, (at_ + length(value))::INTEGER AS end_col, round_even(h, 2) AS entropy_score
  FROM (SELECT *, {entropy("value")} AS h FROM entropic WHERE NOT {REJECT}) WHERE h >= {ENTROPY_THRESHOLD})""",
    "raw": """raw AS (SELECT *, (row_number() OVER (PARTITION BY file_path, seq ORDER BY det, i) - 1)::INTEGER AS rank FROM (SELECT * FROM signatures UNION ALL BY NAME SELECT * FROM entropy_hits))""",
    "merged": f"""marked AS (
  SELECT *, replace(file_path, chr(92), '/') AS np, {BASE} AS base,
    CASE WHEN start_col < max(end_col) OVER (PARTITION BY replace(file_path, chr(92), '/'), commit_hash, line_number ORDER BY start_col, end_col, seq, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM raw),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY np, commit_hash, line_number ORDER BY start_col, end_col, seq, rank) AS island FROM marked),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY np, commit_hash, line_number, island ORDER BY base DESC, length(matched_string) DESC, seq, rank) AS place,
    arg_min(entropy_score, seq * 1000 + rank) FILTER (WHERE entropy_score IS NOT NULL) OVER (PARTITION BY np, commit_hash, line_number, island) AS carried FROM islands),
merged AS (SELECT * EXCLUDE (entropy_score, place, carried, fresh, island), coalesce(entropy_score, carried) AS entropy_score FROM ranked WHERE place = 1)""",
    "deduped": """placed AS (
  SELECT *, row_number() OVER (PARTITION BY np, matched_string ORDER BY commit_hash IS NULL DESC, CASE WHEN commit_hash IS NULL THEN base END DESC, CASE WHEN commit_hash IS NULL THEN length(matched_string) END DESC,
      CASE WHEN commit_hash IS NULL THEN seq ELSE -seq END, CASE WHEN commit_hash IS NULL THEN rank ELSE -rank END) AS place,
    count(*) OVER (PARTITION BY np, matched_string) AS copies FROM merged),
per AS (
  SELECT np, matched_string, min(seq * 1000 + rank) AS lead, arg_min(entropy_score, seq * 1000 + rank) FILTER (WHERE entropy_score IS NOT NULL) AS carried FROM merged GROUP BY np, matched_string),
gone AS (SELECT np, matched_string, commit_hash, max(seq * 1000 + rank) AS last FROM merged WHERE commit_hash IS NOT NULL GROUP BY ALL),
commits AS (SELECT np, matched_string, list(commit_hash ORDER BY last DESC) AS history_commits FROM gone GROUP BY np, matched_string),
deduped AS (
  SELECT p.detector_type, p.matched_string, p.file_path, p.line_number, p.commit_hash, p.line_content, coalesce(p.entropy_score, per.carried) AS entropy_score, p.start_col, p.end_col, p.copies::INTEGER AS occurrences,
    coalesce(c.history_commits, []) AS history_commits, per.lead AS lead
  FROM placed p JOIN per ON p.np = per.np AND p.matched_string = per.matched_string LEFT JOIN commits c ON p.np = c.np AND p.matched_string = c.matched_string WHERE p.place = 1)""",
    "scored": f"""facts AS (SELECT *, {FILE_CLASS} AS file_class, {BASE} AS base, {REDACT} AS redacted, {PLACEHOLDER} AS placeholder FROM deduped),
summed AS (
  SELECT *, base + CASE file_class {" ".join(f"WHEN '{k}' THEN {p}" for k, (p, _) in CLASS_POINTS.items())} ELSE 0 END - CASE WHEN commit_hash IS NOT NULL THEN 5 ELSE 0 END
      + CASE WHEN entropy_score >= 4.5 THEN 10 WHEN entropy_score >= 4.0 THEN 5 ELSE 0 END AS total,
    concat_ws(', ', detector_type || ' pattern (base ' || base || ')', CASE file_class {" ".join(f"WHEN '{k}' THEN {text(r)}" for k, (_, r) in CLASS_POINTS.items())} END,
      CASE WHEN commit_hash IS NOT NULL THEN 'history-only, removed from working tree (-5)' END,
      CASE WHEN entropy_score >= 4.5 THEN 'very high entropy ' || {NUM} || ' (+10)' WHEN entropy_score >= 4.0 THEN 'high entropy ' || {NUM} || ' (+5)' END,
      CASE WHEN placeholder THEN 'looks like a placeholder (capped)' END) AS reasons FROM facts),
capped AS (SELECT * EXCLUDE (total), CASE WHEN placeholder THEN least(total, 10) ELSE total END::INTEGER AS points FROM summed),
banded AS (SELECT *, CASE {" ".join(f"WHEN points >= {p} THEN {b}" for p, b in BANDS)} ELSE 1 END::INTEGER AS severity FROM capped),
kept AS (
  SELECT detector_type, file_path, line_number, severity, points, CASE WHEN commit_hash IS NULL THEN 'working_tree' ELSE 'history_only' END AS exposure, commit_hash, redacted,
    substr(trim(replace(substr(line_content, 1, start_col) || redacted || substr(line_content, end_col + 1), matched_string, redacted)), 1, 200) AS redacted_context,
    ['Low', 'Medium', 'High', 'Critical'][severity] || ' severity: ' || redacted || ' (' || detector_type || '), ' || CASE WHEN commit_hash IS NOT NULL THEN 'only in git history (commit ' || commit_hash || ')' || CASE WHEN len(history_commits) > 1 THEN ', seen in ' || len(history_commits) || ' commits' ELSE '' END
      ELSE 'still in the working tree' || CASE WHEN len(history_commits) > 0 THEN ' and committed to history (introduced in ' || history_commits[1] || ', ' || len(history_commits) || ' commit(s))' ELSE '' END END
      || '. Score ' || points || ' from ' || reasons || '.' AS rationale,
    entropy_score, file_class, occurrences, history_commits, lead, placeholder FROM banded),
scored AS (SELECT * EXCLUDE (placeholder) FROM kept WHERE NOT placeholder)""",
}


def upto(layer: str, query: str, extra: str = "") -> str:
    """WITH all layers up to the named one (and extra ones), then the query."""
    names = list(LAYERS)
    parts = [LAYERS[n] for n in names[: names.index(layer) + 1]]
    return "WITH " + ",\n".join(parts + ([extra] if extra else [])) + "\n" + query
