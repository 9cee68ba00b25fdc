"""Detectors, deduplication, scoring, remediation and baseline on small inputs."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from leakscan.api import ScanOptions, findings
from leakscan.functions.regexes import PatternError, Signature, default_signatures, load_signatures, spark_regex
from leakscan.operators import baseline, dedup, detect, remediate, score, verify
from leakscan.operators.dedup import line_findings, span_clusters
from leakscan.operators.detect import free
from leakscan.operators.gitlog import parse_log

LINES = "file_path string, commit_hash string, line_number int, line_content string, seq bigint"
HEX = "0123456789abcdef"
KEY = "AKIA" + "ABCDEFGH12345678"
POSITIVE = {
    "AWS_ACCESS_KEY": KEY,
    "AWS_SECRET_KEY": 'aws_secret_access_key = "' + HEX * 2 + 'abcdefgh"',
    "GENERIC_API_KEY": "api-key: '" + HEX + "'",
    "GENERIC_SECRET": 'SECRET="' + HEX + '"',
    "GENERIC_PASSWORD": "pwd = 'abc1'",
    "SLACK_TOKEN": "xox" + "b-0123456789",
    "SLACK_WEBHOOK": "https://hooks.slack" + ".com/services/T12345678/B12345678/" + HEX + "abcdefgh",
    "PRIVATE_KEY_HEADER": "-----BEGIN " + "RSA PRIVATE KEY-----",
    "DB_CONNECTION_STRING": "Postgres://u:pw@host",
    "JWT": "ey" + "Jabc.def.ghi",
    "GITHUB_TOKEN": "gh" + "p_" + HEX * 2 + "abcd",
    "GOOGLE_API_KEY": "AI" + "za" + HEX * 2 + "abc",
    "STRIPE_KEY": "sk_" + "live_" + HEX + "abcdefgh",
}


def frame(spark, lines, path="src/a.py", commit=None):
    return spark.createDataFrame([(path, commit, i, x, i) for i, x in enumerate(lines, 1)], LINES)


def hits(spark, lines, **options):
    rows = detect.raw_findings(frame(spark, lines), **options).collect()
    return sorted((r.line_number, r.rank, r.detector_type, r.matched_string, r.start_col, r.end_col, r.entropy_score) for r in rows)


def test_every_signature_has_a_positive_line(spark):
    found = hits(spark, list(POSITIVE.values()))
    for n, kind in enumerate(POSITIVE, 1):
        assert any(h[0] == n and h[2] == kind for h in found), kind
    for h in found:
        assert list(POSITIVE.values())[h[0] - 1][h[4] : h[5]] == h[3]


def test_quiet_lines(spark):
    assert hits(spark, ["", "for i in range(3): pass", "key = 1", "password", 'token = "short"', "AKIA" + "abc"]) == []


def test_spans_with_wide_characters_and_repeats(spark):
    line = '\U0001f600é token = "' + HEX + '" token = "' + HEX + '"'
    assert [(h[2], line[h[4] : h[5]]) for h in hits(spark, [line])] == [("GENERIC_SECRET", HEX)] * 2 + [("HIGH_ENTROPY", HEX)] * 2


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1= :'\" éA_-kéytoken", max_size=40), min_size=1, max_size=12))
def test_matches_equal_python(spark, lines):
    lines = [x.replace("\n", "") for x in lines]
    df = frame(spark, lines)
    for regex, groups in ((detect.QUOTED, (1, 2)), (detect.ASSIGNMENT, (1, 2, 3, 4))):
        rows = df.select("line_number", detect.matches(df.line_content, regex, groups).alias("m")).collect()
        for r in rows:
            want = [(m.start(), m.group(), *[m.group(g) or "" for g in groups]) for m in re.finditer(regex, lines[r.line_number - 1])]
            assert [tuple(m) for m in r.m] == want


def test_entropy_passes(spark):
    v = "aB3dE6gH9jK2mN5p"
    found = hits(spark, [f"auth_token={v}", f'login("{v}", "credential")', f'note = "{v}"', 'secret_path("/usr/share/abcdefgh1234567")', 'token = os.environ["DB_PASSWORD_XY12"]', "key=12345678901234567890", 'x: "deadbeef-dead-beef-dead-beefdeadbeef" # key'])
    assert [(h[0], h[3]) for h in found] == [(1, v), (2, v)]
    assert found[0][6] == 4.0


def test_custom_signatures_use_python_where_needed(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('[{"type": "EDGE", "regex": "(?<=id:)(?P<value>[a-z]{4})\\\\b"}, {"type": "FLAT", "regex": "zz[0-9]+", "flags": ["ignorecase"]}]')
    own = load_signatures(str(path))
    assert [s.expressible for s in own] == [False, True]
    found = hits(spark, ["id:abcd ZZ12", "id:abcde"], signatures=own)
    assert sorted((h[0], h[2], h[3], h[4]) for h in found) == [(1, "EDGE", "abcd", 3), (1, "FLAT", "ZZ12", 8)]


@pytest.mark.parametrize("text", ["{", '{"a": 1}', '[{"type": "A"}]', '[{"type": "A", "regex": "("}]', '[{"type": "A", "regex": "a", "flags": ["X"]}]'])
def test_bad_signature_files(tmp_path, text):
    path = tmp_path / "p.json"
    path.write_text(text)
    with pytest.raises(PatternError):
        load_signatures(str(path))
    with pytest.raises(PatternError):
        load_signatures(str(tmp_path / "none.json"))


def test_regex_translation():
    assert spark_regex(r"(?P<value>[^\s'])\s") .startswith("([^\\s")
    assert all(s.expressible for s in default_signatures())
    assert not Signature("x", "", "^abc").expressible


RAW = "detector_type string, matched_string string, file_path string, line_number int, commit_hash string, line_content string, entropy_score double, start_col int, end_col int, seq bigint, rank int"


def raws(spark, rows):
    keys = ("detector_type", "matched_string", "file_path", "line_number", "commit_hash", "line_content", "entropy_score", "start_col", "end_col")
    base = {"file_path": "a.py", "line_number": 1, "commit_hash": None, "line_content": "", "entropy_score": None, "start_col": None, "end_col": None}
    return spark.createDataFrame([tuple((base | r)[k] for k in keys) + (r.get("seq", i), 0) for i, r in enumerate(rows)], RAW)


def test_dedup_overlap_and_evidence(spark):
    rows = [
        {"detector_type": "HIGH_ENTROPY", "matched_string": "abcdefgh", "start_col": 0, "end_col": 8, "entropy_score": 4.2},
        {"detector_type": "AWS_ACCESS_KEY", "matched_string": "bcdefg", "start_col": 1, "end_col": 7},
        {"detector_type": "JWT", "matched_string": "zzzz", "start_col": 20, "end_col": 24},
        {"detector_type": "JWT", "matched_string": "nocols"},
        {"detector_type": "JWT", "matched_string": "nocols", "file_path": "b.py"},
    ]
    got = {(r.file_path, r.matched_string): r for r in dedup.deduplicate(raws(spark, rows)).collect()}
    assert set(got) == {("a.py", "bcdefg"), ("a.py", "zzzz"), ("a.py", "nocols"), ("b.py", "nocols")}
    assert got["a.py", "bcdefg"].entropy_score == 4.2


def test_own_points_choose_the_finding(spark):
    rows = [{"detector_type": t, "matched_string": "abcdefgh", "start_col": 0, "end_col": 8} for t in ("MINE", "AWS_ACCESS_KEY")]
    top = lambda **o: dedup.deduplicate(raws(spark, rows), **o).first().detector_type
    assert top() == "AWS_ACCESS_KEY" and top(points=lambda t: F.when(t == "MINE", 99).otherwise(1)) == "MINE"


def test_entropy_options(spark):
    lines = frame(spark, ['auth = "aB3dE6gH9jK2"', 'anchor = "aB3dE6gH9jK2mN5p"'])
    found = lambda **o: sorted(r.line_number for r in findings(lines, ScanOptions(**o)).collect())
    assert found() == [1] and found(entropy_min_length=14) == [] and found(entropy_threshold=4.1) == []
    assert found(entropy_words=("anchor",)) == [2]


def test_dedup_across_commits(spark):
    rows = [{"detector_type": "JWT", "matched_string": "s", "commit_hash": c, "line_number": n, "file_path": p, "seq": q} for q, (c, n, p) in enumerate([(None, 4, "d\\a"), ("c3", 3, "d/a"), ("c2", 2, "d/a"), ("c3", 9, "d/a"), ("c1", 1, "d/a"), ("x2", 2, "e"), ("x1", 1, "e")])]
    got = {r.file_path.replace("\\", "/"): r for r in dedup.deduplicate(raws(spark, rows)).collect()}
    assert (got["d/a"].commit_hash, got["d/a"].line_number, got["d/a"].occurrences, got["d/a"].history_commits) == (None, 4, 5, ["c1", "c3", "c2"])
    assert (got["e"].commit_hash, got["e"].line_number, got["e"].history_commits) == ("x1", 1, ["x1", "x2"])


def test_row_local_clusters_equal_grouped_ones(spark):
    lines = frame(spark, [*POSITIVE.values(), *[f"{a} {b}" for a in list(POSITIVE.values())[:4] for b in list(POSITIVE.values())[2:6]]])
    key = lambda df: sorted(map(str, df.collect()))
    assert key(dedup.line_findings(lines)) == key(dedup.collapse_lines(detect.raw_findings(lines)))


def one(spark, secret, path="x", kind="JWT", context=score.ScanContext(), **more):
    df = dedup.deduplicate(raws(spark, [{"detector_type": kind, "matched_string": secret, "file_path": path, "line_content": f"  {secret}  ", "start_col": 2, "end_col": 2 + len(secret)} | more]))
    return score.scored(df, context).collect()


@pytest.mark.parametrize(("path", "label"), [("a/.env.local", "env"), ("README.md", "docs"), ("c.yml", "config"), ("a\\b.PY", "source"), ("tests/a.py", "test"), ("example", "test"), ("Makefile", "other"), (".yml", "other"), ("x.tar.md", "docs")])
def test_file_classes(spark, path, label):
    assert one(spark, "value-1234567", path)[0].file_class == label


def test_points_and_bands(spark):
    r = one(spark, "value-1234567", ".env", "AWS_ACCESS_KEY", entropy_score=4.5)[0]
    assert (r.points, r.severity) == (75, 4)
    r = one(spark, "value-1234567", "x", "GENERIC_SECRET", commit_hash="abc")[0]
    assert (r.points, r.severity, r.exposure) == (15, 2, "history_only")
    assert one(spark, "value-1234567", "x", "UNKNOWN")[0].points == 25
    assert one(spark, "value-1234567", "docs.md", "GENERIC_SECRET", context=score.ScanContext(min_severity=2)) == []
    with pytest.raises(ValueError):
        score.severity_number("awful")


@pytest.mark.parametrize("value", ["changeme", "your_api_key_here", "xxxxxxxx", "ababababab", "${VAR}", "new-password", "", "os.environ['A']", "sk_test_abc"])
def test_placeholders(spark, value):
    assert one(spark, value) == []
    assert all(r.points <= 10 for r in one(spark, value, context=score.ScanContext(keep_placeholders=True)))


def test_nothing_shows_the_secret(spark):
    r = one(spark, "Sup3rS3cretValue!", "a.py")[0]
    assert r.redacted == "Sup3" + "*" * 13
    assert r.redacted_context == r.redacted
    assert "Sup3rS3cretValue!" not in str(r)


def test_verification(spark):
    found = dedup.deduplicate(raws(spark, [{"detector_type": t, "matched_string": s, "line_number": i} for i, (t, s) in enumerate([("AWS_ACCESS_KEY", KEY), ("AWS_SECRET_KEY", "q" + HEX), ("JWT", "dead-1234"), ("JWT", "example1"), ("SLACK_TOKEN", "who-knows")])]))

    def ask(kind, secret, aws):
        return {"AWS_ACCESS_KEY": aws is not None and aws.startswith("q"), "JWT": False}.get(kind)

    got = {r.matched_string: r.verified for r in verify.verified(found, ask).collect()}
    assert got == {KEY: True, "q" + HEX: None, "dead-1234": False, "example1": None, "who-knows": None}
    told = {r.detector_type: r.rationale for r in score.scored(verify.verified(found, ask), score.ScanContext(asked=True)).collect()}
    assert {k for k, v in told.items() if "Not verified" in v} == {"AWS_SECRET_KEY", "SLACK_TOKEN"} and "live" in told["AWS_ACCESS_KEY"]
    points = {r.detector_type: r.points for r in score.scored(verify.verified(found, ask)).collect()}
    assert points["AWS_ACCESS_KEY"] == 80 and points["JWT"] == 10


def test_baseline_round_trip(spark, tmp_path):
    found = score.scored(dedup.deduplicate(raws(spark, [{"detector_type": "JWT", "matched_string": s, "line_number": i} for i, s in enumerate(["secret-one-1", "secret-two-2"])])))
    path = str(tmp_path / "base")
    assert baseline.load(spark, path).count() == 0
    assert baseline.save(path, found.where("line_number = 0")) == 1
    kept, gone = baseline.suppress(found, baseline.load(spark, path))
    assert (kept.count(), gone.count()) == (0, 2)  # same path, type and mask: one fingerprint
    assert score.exit_code(found, "high") == 1 and score.exit_code(found, "none") == 0 and score.exit_code(found.where("false"), "low") == 0
    assert {r.label: r.findings for r in score.severity_counts(found).collect()} == {"Low": 0, "Medium": 0, "High": 2, "Critical": 0}


def test_remediation_and_rewrites(spark):
    found = score.scored(dedup.deduplicate(raws(spark, [{"detector_type": "JWT", "matched_string": "secret-one-1", "commit_hash": "c"}, {"detector_type": "NEW", "matched_string": "secret-two-2", "file_path": "k.pem"}])))
    steps = {r.detector_type: r.remediation_steps for r in remediate.annotate(found).collect()}
    assert steps["JWT"] == remediate.STEPS["JWT"] + remediate.HISTORY and steps["NEW"] == remediate.GENERIC
    assert set(score.BASE_POINTS) == set(remediate.STEPS)
    assert not any(r.fixable for r in remediate.fixable(found).collect())
    df = spark.createDataFrame([('stripe.api_key = "abc"', 18, 21, ".py"), ("x = 'abc'", 5, 8, ".c")], "l string, s int, e int, x string")
    rows = df.select(remediate.rewrite(df.l, df.s, df.e, remediate.env_name(df.l, df.s, df.x), df.x)).collect()
    assert [r[0] for r in rows] == ['stripe.api_key = os.environ["STRIPE_API_KEY"]', None]


def test_log_parser(spark):
    log = ["commit " + "a" * 40, "diff --git a/x b/y", "--- a/x", "+++ b/y", "@@ -1 +5,2 @@", "-old", "+one", "+++two", " ctx", "+three", "commit " + "b" * 40, "+lost"]
    rows = parse_log(spark.createDataFrame([(1, i, x) for i, x in enumerate(log)], "stream int, n bigint, raw string")).collect()
    assert sorted((r.file_path, r.commit_hash, r.line_number, r.line_content) for r in rows) == [("y", "a" * 12, 5, "one"), ("y", "a" * 12, 7, "three")]


def first_fit(spans):
    """Clusters of intervals in their order: each joins the first cluster with an overlapping one."""
    found = []
    for k, (a, b) in enumerate(spans):
        for c in found:
            if any(a < spans[m][1] and spans[m][0] < b for m in c):
                c.append(k)
                break
        else:
            found.append([k])
    return sorted(found)


def test_swept_clusters_equal_first_fit(spark):
    r = random.Random(11)
    cases = [[(s, s + r.randrange(1, w)) for s in (r.randrange(n) for _ in range(k))] for k, n, w in ((9, 20, 9), (30, 40, 12), (60, 500, 20), (200, 3000, 30), (400, 900, 4)) for _ in range(8)]
    kind = "struct<start_col: int, end_col: int, matched_string: string, rank: int>"
    df = spark.createDataFrame([(i, [(a, b, f"m{a}-{b}", k) for k, (a, b) in enumerate(c)]) for i, c in enumerate(cases)], f"i int, h array<{kind}>")
    got = {x.i: sorted(sorted(m["rank"] for m in c) for c in x.c) for x in df.select("i", span_clusters(F.col("h"), kind).alias("c")).collect()}
    assert got == {i: first_fit(c) for i, c in enumerate(cases)}


def test_free_strings_equal_comparing_all(spark):
    r = random.Random(12)

    def disjoint(k):
        at, out = 0, []
        for _ in range(k):
            at += r.randrange(4)
            n = r.randrange(5)
            out.append(("v" * n, at))
            at += n + r.randrange(1, 3)
        return out

    cases = [(disjoint(r.randrange(3, 200)), disjoint(r.randrange(3, 200))) for _ in range(40)]
    df = spark.createDataFrame([(i, q, p) for i, (q, p) in enumerate(cases)], "i int, q array<struct<value: string, at: int>>, p array<struct<value: string, at: int>>")
    got = {x.i: [tuple(y) for y in x.f] for x in df.select("i", free(F.col("q"), F.col("p")).alias("f")).collect()}
    touches = lambda s, e, a, b: s <= a < e or s < b <= e
    assert got == {i: [(v, a) for v, a in q if not any(touches(s, s + len(x), a, a + len(v)) for x, s in p)] for i, (q, p) in enumerate(cases)}


def test_thousands_of_hits_in_a_line(spark):
    line = " ".join(f'token="{k:05d}aBcDeFgHiJkLmN"' for k in range(20_000))
    lines = spark.createDataFrame([("a", None, 1, line, 1)], "file_path string, commit_hash string, line_number int, line_content string, seq bigint")
    begun = time.perf_counter()
    got = line_findings(lines).select("matched_string", "start_col").collect()
    assert sorted(x.start_col for x in got) == [7 + 28 * k for k in range(20_000)] and time.perf_counter() - begun < 60
