"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import K, LicenseRules, template_grams


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _distance(p: str, q: str) -> str:
    half = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    x, y = f"{p}[i]", f"{q}[i]"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half.format(a=x, b=y)} + {half.format(a=y, b=x)})) / 2))"


# Fixed values, written a second time so that the SQL checks them: character classes, symbols, common words, limits.
SETS = ["A-Z", "0-9", ".!?", ",;:", "''\"()\\-", "\\x{C0}-\\x{24F}"]
SYMBOLS = "#*$%&|<>=+/_@~^\\{}[]`"
WORDS = (
    "the of and to in a is that for it as was der die und in den von zu das mit sich des auf "
    "de la le et les des en un du une que est de la que el en y a los del se las por"
)


def quality(source: str = "documents", least_texts: int = 50) -> str:
    """Distances over fine classes and common words, the two limits, and the fence by size: the median of the sums of both
    distances (of distinct texts, in steps of 0.001) and above it six times what the lower quarter lies below, 0.15 at least;
    sizes with few texts are pooled with the next smaller ones, at last with all."""
    blank = r"[\x20\x09-\x0D]+"
    only = lambda s: f"length(regexp_replace(t, '[^{s}]+', '', 'g'))"
    each = lambda c: f"length(t) - length(replace(t, '{c}', ''))"
    classes = ", ".join([*map(only, SETS), *map(each, SYMBOLS)])
    words = sorted(set(WORDS.split()))
    n_class, n_word = len(SETS) + len(SYMBOLS) + 2, len(words) + 1
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])::DOUBLE" for i in range(n)) + "]"
    norm = lambda c: f"list_transform({c}, lambda x: x / greatest(1, list_sum({c})))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM {source}),
w AS (SELECT *, list_filter(string_split_regex(t, '{blank}'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 4),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY rid),
f AS (
  SELECT rid, doc_id, lang, t, len(w) AS n_words, length(regexp_replace(t, '{blank}', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(t) AS n_chars,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    [{classes}, length(t) - length(regexp_replace(t, '{blank}', '', 'g'))] AS classes, w
  FROM w),
c AS (
  SELECT * EXCLUDE (classes), list_append(classes, n_chars - list_sum(classes)::BIGINT) AS class_counts,
    list_transform({_list(words)}, lambda v: len(list_filter(w, lambda x: x = v))) AS found FROM f),
e AS (SELECT *, list_append(found, n_words - list_sum(found)::BIGINT) AS word_counts FROM c),
q AS (SELECT lang, {sums("class_counts", n_class)} AS rc, {sums("word_counts", n_word)} AS rw FROM e WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY lang),
qn AS (SELECT {norm("rc")} AS rc, {norm("rw")} AS rw FROM q),
j AS (
  SELECT e.rid, min({_distance("x.pc", "qn.rc")}) AS class_distance, min({_distance("x.pw", "qn.rw")}) AS word_distance
  FROM e JOIN (SELECT rid, {norm("class_counts")} AS pc, {norm("word_counts")} AS pw FROM e WHERE n_chars > 0 AND n_words > 0) x USING (rid) CROSS JOIN qn GROUP BY e.rid),
v AS (
  SELECT e.*, coalesce(n_repeat_words, 0) AS nr, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS failed, length(bin(n_words)) AS bits,
    CASE WHEN n_chars >= 200 THEN class_distance END AS cd, CASE WHEN n_words >= 50 THEN word_distance END AS wd
  FROM e LEFT JOIN r USING (rid) LEFT JOIN j USING (rid)),
b AS (SELECT bits, floor((cd + wd) / 0.001)::BIGINT AS pos, count(DISTINCT t) AS n FROM v WHERE NOT failed AND cd + wd IS NOT NULL GROUP BY ALL),
s AS (SELECT bits, sum(n) AS n FROM b GROUP BY bits),
p AS (
  SELECT bits, max(low) AS low FROM (
    SELECT x.bits, z.bits AS low, (SELECT sum(y.n) FROM s y WHERE y.bits BETWEEN z.bits AND x.bits) AS held FROM s x JOIN s z ON z.bits <= x.bits) WHERE held >= {least_texts} GROUP BY bits),
o AS (
  SELECT x.bits, b.pos, sum(b.n) AS n FROM s x LEFT JOIN p ON p.bits = x.bits JOIN b ON CASE WHEN p.low IS NULL THEN true ELSE b.bits BETWEEN p.low AND x.bits END GROUP BY x.bits, b.pos),
u AS (SELECT bits, pos, sum(n) OVER (PARTITION BY bits ORDER BY pos) AS so_far, sum(n) OVER (PARTITION BY bits) AS n FROM o),
k AS (SELECT bits, 0.001::DOUBLE * min(pos) FILTER (so_far >= 0.5 * n) AS middle, 0.001::DOUBLE * min(pos) FILTER (so_far >= 0.25 * n) AS lower FROM u GROUP BY bits)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, nr::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (coalesce(cd, 0) > 0.26 OR coalesce(wd, 0) > 0.75 OR coalesce(cd + wd > middle + greatest(0.15, 6 * (middle - lower)), false)) AS kept
FROM v LEFT JOIN k USING (bits)"""


def licenses(rules: LicenseRules = LicenseRules()) -> str:
    grams = ", ".join(f"({n}, '{label}', {base}, {size}, {place}, '{a} {b} {c}')" for n, label, base, size, place, a, b, c in template_grams(rules))
    return rf"""
WITH t(template, label, base, grams, place, gram) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, unnest(range(0, len(w) - {K - 1})) AS place_at, w FROM d WHERE len(w) >= {K}),
h AS (SELECT rid, template, label, base, grams, place, place_at AS spot, place_at - place AS diagonal FROM p JOIN t ON w[place_at + 1] || ' ' || w[place_at + 2] || ' ' || w[place_at + 3] = gram),
v AS (SELECT rid, template, label, base, grams, diagonal, list(place) AS places, min(spot) AS lo, max(spot) + {K - 1} AS hi FROM h GROUP BY ALL),
n AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal), 1000000) > {rules.max_shift} THEN 1 ELSE 0 END AS fresh FROM v),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM n),
m AS (SELECT rid, template, label, base, grams, span, len(list_distinct(flatten(list(places)))) AS votes, min(lo) AS lo FROM s GROUP BY rid, template, label, base, grams, span),
k AS (SELECT * FROM m WHERE CASE WHEN base THEN votes = grams ELSE 100 * votes >= {rules.min_share} * grams END),
a AS (
  SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(lo) FILTER (WHERE base) AS first_word, max(lo) FILTER (WHERE base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(votes / grams) AS score
  FROM k GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (rid)"""


def archives() -> str:
    bits = "list_aggregate(list_transform(string_split(sha1(body), ''), lambda c: bin(16 + ('0x' || c)::INTEGER)[2:]), 'string_agg', '')"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = "list_aggregate(list_transform(range(0, 32), lambda k: '" + alphabet + "'[1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN bits[5 * k + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END))::INTEGER]), 'string_agg', '')"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, {bits} AS bits FROM p),
e AS (SELECT page_id, payload_bytes, {five} AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM e)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM m"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an expression that gives ASCII text, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], range(0, 8)), lambda c, k: {step})"
    each = f"list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({each}, lambda c, b: {byte}), 4294967295::BIGINT)"


def merkle() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    tree = lambda name, source: f"""
{name}(level, k, i, d, n) AS (
  SELECT 0, k, i, d, n FROM {source}
  UNION ALL
  SELECT * FROM (SELECT level + 1, k, i // 3, sha256(string_agg(d, '' ORDER BY i)), ((n + 2) // 3)::BIGINT FROM {name} WHERE n > 1 GROUP BY level + 1, k, i // 3, n))"""  # noqa: E731
    sides = lambda node, first: f"""
  SELECT o.rid, {first} + t.level AS level, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < {node} // (3 ** t.level)::BIGINT), '') AS l,
    coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > {node} // (3 ** t.level)::BIGINT), '') AS r"""  # noqa: E731
    run = "t.n > 1 AND t.i // 3 = {} // (3 ** t.level)::BIGINT // 3"
    return rf"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS k, {leaf("text")} AS d,
    CASE WHEN doc_id IS NOT NULL AND {crc32("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS claimed
  FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM f),
{tree("t", "o")},
s AS (SELECT k, d, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{tree("u", "(SELECT '' AS k, i, d, n FROM s)")},
p AS ({sides("o.i", 0)}
  FROM o JOIN t ON t.k = o.k AND {run.format("o.i")} GROUP BY o.rid, t.level, o.i
  UNION ALL {sides("s.i", 1000)}
  FROM o JOIN s ON s.k = o.k JOIN u t ON {run.format("s.i")} GROUP BY o.rid, t.level, s.i),
q AS (SELECT rid, string_agg(l || r, '' ORDER BY level) AS proof, list({{'l': l, 'r': r}} ORDER BY level) AS steps FROM p GROUP BY rid),
z AS (
  SELECT o.doc_id, o.d AS leaf, s.d AS subroot, (SELECT d FROM u WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([{{'l': claimed, 'r': ''}}], coalesce(steps, [])), lambda a, b: {{'l': sha256(b.l || a.l || b.r), 'r': ''}}).l AS folded_root
  FROM o JOIN s ON s.k = o.k LEFT JOIN q ON q.rid = o.rid)
SELECT *, folded_root = root AS verified FROM z"""


def trie() -> str:
    what = "md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
    return f"""
WITH t AS (
  SELECT conv_id AS c, {what} AS what, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {what}) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS base, {crc32("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (
  SELECT h.c, place, what, n FROM h JOIN t ON t.c = h.base AND place < h.h
  UNION ALL SELECT h.c, place, what, n FROM h JOIN t ON t.c = h.c AND place >= h.h),
p AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY place) AS d, n, string_agg(what, '') OVER (PARTITION BY c ORDER BY place) AS node FROM u
  UNION ALL SELECT c, 0, 0, '' FROM h),
e AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS ends FROM p),
v AS (
  SELECT node, d AS depth, min(c) AS conv_id, count(*) AS n_convs, min(n) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM e GROUP BY node, d),
k AS (SELECT a.node, count(b.node) AS n_children FROM v a LEFT JOIN v b ON b.depth = a.depth + 1 AND left(b.node, 32 * a.depth) = a.node GROUP BY a.node),
x AS (SELECT v.*, n_children FROM v JOIN k ON k.node = v.node),
s AS (
  SELECT a.node, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.n) AS saved_tokens
  FROM x a JOIN x b ON b.depth >= a.depth AND left(b.node, 32 * a.depth) = a.node GROUP BY a.node)
SELECT x.conv_id::BIGINT AS conv_id, x.depth::BIGINT AS depth, o.conv_id::BIGINT AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.node = x.node LEFT JOIN x o ON x.depth > 0 AND o.depth = x.depth - 1 AND o.node = left(x.node, 32 * o.depth)"""
