"""The registered queries of the engine and the SQL that checks them.

All run over whole tables: the lines of documents, and a synthetic commit history made from orders (see corpus.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.plan import once, shared_folder, spread
from ..functions.regexes import SIGNATURES, default_signatures
from ..operators import baseline, dedup, detect, remediate, score
from ..operators.gitlog import parse_log
from ..report import sarif
from ..sources import planted
from ..sources.ignore import DEFAULT_IGNORES, GlobRules, ignored
from ..sources.repo import binary_head
from ..streaming.findings import secret_states
from . import oracle
from .corpus import CORPUS_SQL, DOCUMENTS_SQL, SHARED_LINES, corpus, document_lines, text_lines
from .oracle import upto

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.raw_findings(corpus(spark, sf_dir))


def deduped(spark: SparkSession, sf_dir: str, shown: bool = True) -> DataFrame:
    """The path that scans take: hits are clustered inside their line's row. shown: findings carry their line."""
    found = dedup.line_findings(corpus(spark, sf_dir))
    return dedup.collapse_commits(found if shown else found.drop("line_content"))


def found(spark: SparkSession, sf_dir: str, context: score.ScanContext = score.ScanContext(), shown: bool = True) -> DataFrame:
    return score.scored(deduped(spark, sf_dir, shown), context)


def joined(column: str) -> Column:
    return F.array_join(column, ",")


# --- scans -----------------------------------------------------------------------------------------------------------

for _table, _keys in (("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"])):
    _path = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in _keys)

    @query(
        f"""SELECT '{_table}/' || {_path} AS file_path, n::INTEGER AS line_number, length(line)::INTEGER AS width FROM (
        SELECT *, unnest(range(1, len(t) + 1)) AS n, unnest(t) AS line FROM (SELECT *, string_split(text, chr(10)) AS t FROM {_table})) WHERE line <> ''""",
        f"scan_lines_{_table}",
    )
    def _scan(spark, sf_dir, name=_table, keys=tuple(_keys)):
        lines = text_lines(table(spark, sf_dir, name), name, *keys)
        return lines.where(F.col("line_content") != "").select("file_path", "line_number", F.length("line_content").alias("width"))


@query("""SELECT 'pages/' || CAST(page_id AS VARCHAR) AS file_path, n::INTEGER AS line_number, length(line)::INTEGER AS width FROM (
  SELECT page_id, unnest(range(1, len(t) + 1)) AS n, unnest(t) AS line FROM (SELECT page_id, string_split(html, chr(10)) AS t FROM pages)) WHERE line <> ''""")
def scan_lines_pages(spark, sf_dir):
    lines = text_lines(table(spark, sf_dir, "pages").withColumnRenamed("html", "text"), "pages", "page_id")
    return lines.where(F.col("line_content") != "").select("file_path", "line_number", F.length("line_content").alias("width"))


@query(upto("lines", "SELECT count(*) AS lines, count(DISTINCT replace(file_path, chr(92), '/')) AS files, count(DISTINCT commit_hash) AS commits FROM lines"))
def unified_walk(spark, sf_dir):
    return corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct(T.slashes(F.col("file_path"))).alias("files"), F.countDistinct("commit_hash").alias("commits"))


# a log of one commit for each customer, each a stream of its own: one file and one hunk each, with added, removed and marker lines
LOG = """SELECT CAST(c_custkey AS INT) AS stream, CAST(c_custkey * 10 + i AS BIGINT) AS n, CASE i
  WHEN 0 THEN 'commit ' || md5(CAST(c_custkey AS STRING)) || substr(md5('x' || CAST(c_custkey AS STRING)), 1, 8)
  WHEN 1 THEN 'diff --git a/src/f' || CAST(c_custkey % 40 AS STRING) || '.py b/src/f' || CAST(c_custkey % 40 AS STRING) || '.py'
  WHEN 2 THEN '--- a/src/f' || CAST(c_custkey % 40 AS STRING) || '.py'
  WHEN 3 THEN '+++ b/src/f' || CAST(c_custkey % 40 AS STRING) || '.py'
  WHEN 4 THEN '@@ -' || CAST(c_custkey % 90 AS STRING) || ' +' || CAST(c_custkey % 300 + 1 AS STRING) || ',2 @@ def f():'
  WHEN 5 THEN '-old ' || c_name
  WHEN 6 THEN '+token = "' || md5(c_name) || '"'
  WHEN 7 THEN CASE WHEN c_custkey % 5 = 0 THEN '++++ ' || c_name ELSE '+plain ' || c_name END
  WHEN 8 THEN CASE WHEN c_custkey % 7 = 0 THEN '\\ No newline at end of file' ELSE '+third' END
  ELSE '+' || c_mktsegment END AS raw"""


@query(f"""WITH log AS ({LOG} FROM customer CROSS JOIN (SELECT unnest(range(0, 10))::INTEGER AS i) AS steps),
t AS (SELECT *, regexp_extract(raw, '^commit ([0-9a-f]{{7,64}})', 1) AS c, regexp_extract(raw, '^diff --git a/.* b/(.*)$', 1) AS f, regexp_extract(raw, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,\\d+)? @@', 1) AS h FROM log),
u AS (SELECT *, sum(CASE WHEN c <> '' THEN 1 ELSE 0 END) OVER w AS cn, sum(CASE WHEN c <> '' OR f <> '' THEN 1 ELSE 0 END) OVER w AS fn, sum(CASE WHEN c <> '' OR f <> '' OR h <> '' THEN 1 ELSE 0 END) OVER w AS hn FROM t WINDOW w AS (PARTITION BY stream ORDER BY n)),
v AS (SELECT *, max(substr(c, 1, 12)) OVER (PARTITION BY stream, cn) AS commit_hash, max(f) OVER (PARTITION BY stream, fn) AS path, max(h) OVER (PARTITION BY stream, hn) AS base,
  sum(CASE WHEN c = '' AND f = '' AND h = '' AND raw NOT LIKE '-%' AND raw NOT LIKE '+++%' THEN 1 ELSE 0 END) OVER (PARTITION BY stream, hn ORDER BY n) AS moved FROM u)
SELECT stream, n, path AS file_path, commit_hash, (base::INTEGER + moved - 1)::INTEGER AS line_number, substr(raw, 2) AS line_content FROM v
WHERE c = '' AND f = '' AND h = '' AND path <> '' AND base <> '' AND raw LIKE '+%' AND raw NOT LIKE '+++%'""")
def diff_parse_window(spark, sf_dir):
    sql = LOG.replace("\\", "\\\\") + f" FROM parquet.`{sf_dir}/customer.parquet` LATERAL VIEW explode(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9)) AS i"
    return parse_log(spark.sql(sql))


PATHS = """SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'src/a' || p_partkey || '.py' WHEN 1 THEN 'node_modules/x/' || p_partkey || '.js' WHEN 2 THEN 'web/app' || p_partkey || '.min.js'
  WHEN 3 THEN 'img/' || p_partkey || '.png' WHEN 4 THEN 'a/build/out' || p_partkey WHEN 5 THEN 'keep/a.pyc' || p_partkey WHEN 6 THEN 'deep/x/y/__pycache__/z' || p_partkey WHEN 7 THEN 'notes/' || p_partkey || '.pyc' ELSE 'distant/' || p_partkey END AS file_path FROM """


@query(f"""SELECT file_path, regexp_matches(file_path, '(^|/)(\\.git|node_modules|venv|\\.venv|__pycache__|dist|build)/') OR regexp_matches(file_path,
  '(\\.pyc|\\.min\\.js|\\.map|\\.png|\\.jpg|\\.jpeg|\\.gif|\\.ico|\\.pdf|\\.zip|\\.tar|\\.gz|\\.tgz|\\.7z|\\.mp4|\\.mp3|\\.mov|\\.avi|\\.woff|\\.woff2|\\.ttf|\\.eot|\\.exe|\\.dll|\\.so|\\.dylib|\\.bin)$') AS is_ignored FROM ({PATHS} part)""")
def ignore_filter(spark, sf_dir):
    return spark.sql(PATHS + f"parquet.`{sf_dir}/part.parquet`").select("file_path", ignored(F.col("file_path"), DEFAULT_IGNORES).alias("is_ignored"))


GLOBS = ["node_modules/", "*.min.js", "img/*.png", "build/", "a.pyc[0-4]*", "notes/?[!0-5]*.pyc", "__pycache__", "src/*"]
_GLOB_SQL = " OR ".join(f"p GLOB '{g.rstrip('/')}' OR p GLOB '*/{g.rstrip('/')}'" + (f" OR starts_with(p, '{g}') OR contains(p, '/{g}')" if g.endswith("/") else "") for g in GLOBS)


@query(f"SELECT file_path, {_GLOB_SQL} AS is_ignored FROM (SELECT file_path, replace(file_path, chr(92), '/') AS p FROM ({PATHS} part))")
def ignore_reduced(spark, sf_dir):
    return spark.sql(PATHS + f"parquet.`{sf_dir}/part.parquet`").select("file_path", GlobRules(GLOBS).column(F.col("file_path")).alias("is_ignored"))


@query("""SELECT doc_id, text = '' AS empty, contains(head, chr(0)) OR strlen(regexp_replace(head, '[\\x07-\\x0a\\x0c\\x0d\\x1b\\x20-\\x7e]|[^\\x00-\\x7f]', '', 'g')) * 10 > 3 * strlen(head) AS binary
FROM (SELECT doc_id, text, substr(text, 1, 2048) AS head FROM documents WHERE text IS NOT NULL)""")
def binary_ratio(spark, sf_dir):
    """The sources' own test of a file's first bytes, on texts' first 2048 characters (8192 bytes at most)."""
    texts = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return texts.select("doc_id", (F.col("text") == "").alias("empty"), binary_head(F.encode(F.substring("text", 1, 2048), "UTF-8")).alias("binary"))


# --- planted histories -----------------------------------------------------------------------------------------------

# the choices of a planted history, with values of its own: types in order of their names, five places, four commits
_TYPES = ["AWS_ACCESS_KEY", "AWS_SECRET_KEY", "DB_CONNECTION_STRING", "GENERIC_API_KEY", "GENERIC_PASSWORD", "GENERIC_SECRET", "GITHUB_TOKEN", "GOOGLE_API_KEY", "HIGH_ENTROPY", "JWT", "PRIVATE_KEY_HEADER", "SLACK_TOKEN", "SLACK_WEBHOOK", "STRIPE_KEY"]
_EXCLUDED = ("SLACK_TOKEN", "SLACK_WEBHOOK", "STRIPE_KEY")


def _planted_sql(exclude: tuple[str, ...] = ()) -> str:
    digit = lambda i: f"(instr('0123456789abcdef', substr(m, {i}, 1)) - 1)"
    return f"""drawn AS (SELECT *, [{oracle.listed(_TYPES)}][({digit(2)} * 16 + {digit(3)}) % 14 + 1] AS kind, {digit(4)} % 5 AS place, {digit(5)} % 4 AS step,
  CASE WHEN {digit(1)} < 4 THEN 'live' WHEN {digit(1)} < 7 THEN 'deleted' WHEN {digit(1)} < 9 THEN 'uncommitted' WHEN {digit(1)} < 11 THEN 'skipped' WHEN {digit(1)} < 12 THEN 'ignored' WHEN {digit(1)} < 14 THEN 'placeholder' ELSE 'clean' END AS fate
  FROM (SELECT o_orderkey AS k, md5('7:' || o_orderkey) AS m FROM orders)),
named AS (SELECT *, CASE WHEN kind IN ({oracle.listed(exclude or [''])}) AND fate <> 'placeholder' THEN 'clean' ELSE fate END AS outcome FROM drawn),
planted AS (SELECT k, outcome, CASE WHEN outcome IN ('placeholder', 'clean') THEN '-' ELSE kind END AS detector_type,
  CASE outcome WHEN 'skipped' THEN 'node_modules/leaky/' WHEN 'ignored' THEN 'vendor/' ELSE '' END
    || CASE place WHEN 0 THEN 'deploy/' || k || '/.env' WHEN 1 THEN 'config/c' || k || '.yml' WHEN 2 THEN 'src/m' || k || '.py' WHEN 3 THEN 'tests/test_' || k || '.py' ELSE 'docs/p' || k || '.md' END AS file_path,
  substr(md5('7commit' || step), 1, 12) AS commit_hash FROM named)"""


def planted_scan(spark: SparkSession, sf_dir: str, rules: planted.PlantRules = planted.PlantRules()) -> tuple[DataFrame, DataFrame]:
    """The files of a planted history of one file for each order, and the scored findings of a scan of everything in it."""
    keys = spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    files = planted.planted_files(keys, rules)
    lines = planted.heeded(planted.planted_lines(files, rules))
    return files, score.scored(dedup.collapse_commits(dedup.line_findings(lines).drop("line_content")))


@query(f"""WITH {_planted_sql()} SELECT file_path, commit_hash, 2::BIGINT AS lines FROM planted WHERE outcome <> 'uncommitted'
  UNION ALL SELECT file_path, NULL AS commit_hash, 2::BIGINT AS lines FROM planted WHERE outcome <> 'deleted'""")
def planted_history(spark, sf_dir):
    files = planted.planted_files(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    return planted.planted_lines(files).groupBy("file_path", "commit_hash").agg(F.count(F.lit(1)).alias("lines"))


# every planted secret is found by its type, with the exposure and the commits that are due; what must be silent is
_DUE = """SELECT outcome, detector_type, n AS planted, leak * n AS found_full, CASE WHEN outcome = 'skipped' THEN 0 ELSE leak * n END AS found_quick, leak * n AS exposed, leak * n AS dated, 0::BIGINT AS others
  FROM (SELECT outcome, detector_type, count(*) AS n, CASE WHEN outcome IN ('live', 'deleted', 'uncommitted', 'skipped') THEN 1 ELSE 0 END AS leak FROM planted GROUP BY ALL)"""


@query(f"WITH {_planted_sql()} {_DUE}")
def planted_found(spark, sf_dir):
    return planted.planted_check(*planted_scan(spark, sf_dir))


@query(f"WITH {_planted_sql(_EXCLUDED)} {_DUE}")
def planted_excluded(spark, sf_dir):
    """As planted_found, of a history that never holds some types."""
    return planted.planted_check(*planted_scan(spark, sf_dir, planted.PlantRules(exclude=_EXCLUDED)))


@query(upto("scored", "SELECT replace(file_path, chr(92), '/') AS file_path, redacted, count(*) AS n FROM scored GROUP BY 1, 2 HAVING count(*) > 1"))
def repeated_findings(spark, sf_dir):
    return planted.repeated(found(spark, sf_dir, shown=False))


@query(upto("scored", """SELECT replace(file_path, chr(92), '/') AS file_path, max(points) AS points, max(points) FILTER (WHERE detector_type = 'AWS_ACCESS_KEY') AS aws_access_key,
  max(points) FILTER (WHERE detector_type = 'GENERIC_SECRET') AS generic_secret FROM scored GROUP BY 1"""))
def top_points(spark, sf_dir):
    return planted.top_points(found(spark, sf_dir, shown=False), "AWS_ACCESS_KEY", "GENERIC_SECRET")


# --- detectors -------------------------------------------------------------------------------------------------------

HIT_COLUMNS = ["file_path", "commit_hash", "line_number", "matched_string", "start_col", "end_col"]

for _n, _s in enumerate(SIGNATURES):

    @query(upto("lines", f"SELECT {', '.join(HIT_COLUMNS)} FROM ({oracle.signature_sql(_n)})"), f"detect_{_s[0].lower()}")
    def _detect(spark, sf_dir, n=_n):
        hits = detect.signature_hits(F.col("line_content"), default_signatures()[n])
        lines = detect.hinted(corpus(spark, sf_dir))
        return lines.select("file_path", "commit_hash", "line_number", F.explode(hits).alias("h")).select("file_path", "commit_hash", "line_number", "h.matched_string", "h.start_col", "h.end_col")


@query(upto("signatures", "SELECT detector_type, count(*) AS hits, count(DISTINCT matched_string) AS secrets, sum(start_col)::BIGINT AS starts FROM signatures GROUP BY 1"))
def detect_regex_all(spark, sf_dir):
    hits = detect.hinted(corpus(spark, sf_dir)).select(F.explode(detect.regex_hits(F.col("line_content"))).alias("h"))
    return hits.groupBy(F.col("h.type").alias("detector_type")).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("h.matched_string").alias("secrets"), F.sum("h.start_col").alias("starts"))


@query(upto("signatures", f"SELECT detector_type, {', '.join(HIT_COLUMNS)} FROM signatures"))
def detect_regex_spans(spark, sf_dir):
    lines = detect.hinted(corpus(spark, sf_dir))
    hits = lines.select("file_path", "commit_hash", "line_number", F.explode(detect.regex_hits(F.col("line_content"))).alias("h"))
    return hits.select(F.col("h.type").alias("detector_type"), "file_path", "commit_hash", "line_number", "h.matched_string", "h.start_col", "h.end_col")


@query(upto("entropic", f"SELECT {', '.join(HIT_COLUMNS)}, entropy_score, det = 101 AS fallback FROM entropy_hits"))
def entropy_detector(spark, sf_dir):
    lines = corpus(spark, sf_dir).where(detect.suspicious(F.col("line_content")))
    hits = lines.select("file_path", "commit_hash", "line_number", "line_content", F.explode(detect.entropy_hits(F.col("line_content"))).alias("h"))
    # what no assignment holds came from the fallback
    assigned = F.exists(detect.assignments(F.col("line_content")), lambda p: p["value"] == F.col("h.matched_string"))
    return hits.select("file_path", "commit_hash", "line_number", "h.matched_string", "h.start_col", "h.end_col", "h.entropy_score", (~assigned).alias("fallback"))


@query(upto("pairs", f"SELECT value, round({oracle.entropy('value')}, 6) AS bits, round_even({oracle.entropy('value')}, 2) AS score FROM (SELECT DISTINCT value FROM pairs WHERE value <> '')"))
def shannon_entropy(spark, sf_dir):
    values = corpus(spark, sf_dir).select(F.explode(detect.assignments(F.col("line_content"))).alias("p")).select("p.value").where("value <> ''").distinct()
    return values.select("value", F.round(T.entropy(F.col("value")), 6).alias("bits"), F.bround(T.entropy(F.col("value")), 2).alias("score"))


@query(upto("pairs", f"SELECT {oracle.REJECT} AS rejected, regexp_matches(lower(name), '{oracle.CONTEXT}') AS suspicious, count(*) AS n FROM pairs GROUP BY 1, 2"))
def entropy_rejects(spark, sf_dir):
    pairs = corpus(spark, sf_dir).where(F.col("line_content") != "").select(F.explode(detect.assignments(F.col("line_content"))).alias("p")).select("p.*")
    return pairs.groupBy((~detect.possible_secret(F.col("value"))).alias("rejected"), detect.suspicious(F.col("name")).alias("suspicious")).agg(F.count(F.lit(1)).alias("n"))


@query(upto("lines", f"SELECT count(*) FILTER (WHERE regexp_matches(lower(line_content), '{oracle.CONTEXT}')) AS suspicious, count(*) FILTER (WHERE line_content <> '') AS lines FROM lines"))
def context_words(spark, sf_dir):
    return corpus(spark, sf_dir).agg(F.count_if(detect.suspicious(F.col("line_content"))).alias("suspicious"), F.count_if(F.col("line_content") != "").alias("lines"))


@query(upto("raw", f"SELECT detector_type, {', '.join(HIT_COLUMNS)}, entropy_score, seq, rank FROM raw"))
def raw_findings(spark, sf_dir):
    return raw(spark, sf_dir).select("detector_type", *HIT_COLUMNS, "entropy_score", "seq", "rank")


# --- deduplication ---------------------------------------------------------------------------------------------------


@query(upto("merged", f"SELECT detector_type, {', '.join(HIT_COLUMNS)}, entropy_score FROM merged").replace(*SHARED_LINES))
def dedup_overlap(spark, sf_dir):
    """Findings of any origin, several rows for a line."""
    return dedup.collapse_lines(detect.raw_findings(corpus(spark, sf_dir, shared=True))).select("detector_type", *HIT_COLUMNS, "entropy_score")


@query(upto("deduped", f"SELECT detector_type, {', '.join(HIT_COLUMNS)}, occurrences FROM deduped"))
def dedup_across_commits(spark, sf_dir):
    return deduped(spark, sf_dir, shown=False).select("detector_type", *HIT_COLUMNS, "occurrences")


@query(upto("deduped", "SELECT file_path, matched_string, array_to_string(history_commits, ',') AS commits, len(history_commits)::INTEGER AS n FROM deduped"))
def history_commits(spark, sf_dir):
    return deduped(spark, sf_dir, shown=False).select("file_path", "matched_string", joined("history_commits").alias("commits"), F.size("history_commits").alias("n"))


@query(upto("deduped", "SELECT detector_type, entropy_score, count(*) AS n FROM deduped WHERE detector_type <> 'HIGH_ENTROPY' AND entropy_score IS NOT NULL GROUP BY 1, 2"))
def entropy_carry(spark, sf_dir):
    carried = deduped(spark, sf_dir, shown=False).where("detector_type <> 'HIGH_ENTROPY' AND entropy_score IS NOT NULL")
    return carried.groupBy("detector_type", "entropy_score").agg(F.count(F.lit(1)).alias("n"))


@query(upto("deduped", f"SELECT detector_type, {', '.join(HIT_COLUMNS)}, entropy_score, occurrences, array_to_string(history_commits, ',') AS commits FROM deduped"))
def stream_secret_states(spark, sf_dir):
    """The states that a stream over the same lines ends with, in several batches."""
    folder = shared_folder(spark, "stream")
    lines, files = corpus(spark, sf_dir), spark.sparkContext.defaultParallelism
    # three batches, of a file for each core
    lines.repartition(3 * files, "seq").write.parquet(f"{folder}/lines")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/lines")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/states/n={n}")

    run = secret_states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    states = spark.read.parquet(f"{folder}/states")
    last = states.groupBy(T.slashes(F.col("file_path")).alias("np"), "matched_string").agg(F.max_by(F.struct(*[c for c in states.columns if c != "matched_string"]), "batch").alias("s"))
    return last.select("s.detector_type", *[c if c == "matched_string" else f"s.{c}" for c in HIT_COLUMNS], "s.entropy_score", "s.occurrences", joined("s.history_commits").alias("commits"))


# --- scoring ---------------------------------------------------------------------------------------------------------


@query(upto("deduped", f"SELECT DISTINCT matched_string, {oracle.PLACEHOLDER} AS placeholder FROM deduped"))
def placeholder_filter(spark, sf_dir):
    return deduped(spark, sf_dir, shown=False).select("matched_string", T.is_placeholder(F.col("matched_string")).alias("placeholder")).distinct()


@query(upto("deduped", f"SELECT count(*) AS n FROM deduped WHERE length(matched_string) >= 8 AND len(list_distinct({oracle.chars('matched_string')})) <= 2"))
def low_variety(spark, sf_dir):
    flat = (F.length("matched_string") >= 8) & (F.size(F.array_distinct(T.characters(F.col("matched_string")))) <= 2)
    return deduped(spark, sf_dir, shown=False).agg(F.count_if(flat).alias("n"))


@query(upto("lines", f"SELECT DISTINCT file_path, {oracle.FILE_CLASS} AS file_class FROM lines"))
def file_class(spark, sf_dir):
    return corpus(spark, sf_dir).select("file_path").distinct().select("file_path", T.file_class(F.col("file_path")).alias("file_class"))


@query(upto("raw", f"SELECT detector_type, {oracle.BASE}::INTEGER AS base, count(*) AS n FROM raw GROUP BY 1, 2"))
def base_points(spark, sf_dir):
    return raw(spark, sf_dir).groupBy("detector_type", score.base_points(F.col("detector_type")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


@query(upto("deduped", f"SELECT matched_string, {oracle.REDACT} AS redacted FROM (SELECT DISTINCT matched_string FROM deduped)"))
def redact_secret(spark, sf_dir):
    return deduped(spark, sf_dir, shown=False).select("matched_string").distinct().select("matched_string", T.redact(F.col("matched_string")).alias("redacted"))


SCORED = ["detector_type", "file_path", "line_number", "severity", "points", "exposure", "commit_hash", "redacted", "redacted_context", "rationale", "entropy_score", "file_class", "occurrences"]


@query(upto("scored", f"SELECT {', '.join(SCORED)}, array_to_string(history_commits, ',') AS history_commits FROM scored"))
def filter_and_score(spark, sf_dir):
    return found(spark, sf_dir).select(*SCORED, joined("history_commits").alias("history_commits"))


@query(upto("scored", "SELECT file_path, redacted, points, severity, exposure, redacted_context, rationale FROM kept"))
def keep_placeholders(spark, sf_dir):
    return found(spark, sf_dir, score.ScanContext(keep_placeholders=True)).select("file_path", "redacted", "points", "severity", "exposure", "redacted_context", "rationale")


@query(upto("scored", "SELECT file_path, redacted, detector_type, points FROM scored WHERE severity >= 3"))
def min_severity(spark, sf_dir):
    return found(spark, sf_dir, score.ScanContext(min_severity=score.severity_number("high")), shown=False).select("file_path", "redacted", "detector_type", "points")


@query(upto("scored", "SELECT points, severity, exposure, count(*) AS n FROM scored GROUP BY ALL"))
def score_points(spark, sf_dir):
    return found(spark, sf_dir, shown=False).groupBy("points", "severity", "exposure").agg(F.count(F.lit(1)).alias("n"))


@query(upto("scored", "SELECT s AS severity, ['Low', 'Medium', 'High', 'Critical'][s] AS label, count(scored.severity) AS findings FROM (SELECT unnest([1, 2, 3, 4])::INTEGER AS s) LEFT JOIN scored ON s = scored.severity GROUP BY 1, 2"))
def severity_counts(spark, sf_dir):
    return score.severity_counts(found(spark, sf_dir, shown=False))


@query(upto("scored", "SELECT detector_type, redacted, file_path, severity, points FROM scored ORDER BY severity DESC, points DESC, lead LIMIT 100"))
def sort_worst_first(spark, sf_dir):
    """The report's first page: a top-k report."""
    return score.worst_first(found(spark, sf_dir, shown=False)).select("detector_type", "redacted", "file_path", "severity", "points").limit(100)


@query(upto("scored", "SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END::INTEGER AS code FROM scored WHERE severity >= 4"))
def gate_exit_code(spark, sf_dir):
    return found(spark, sf_dir, shown=False).agg(F.coalesce(F.bool_or(F.col("severity") >= 4), F.lit(False)).cast("int").alias("code"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query(upto("deduped", """SELECT d.file_path, d.matched_string AS access_key, s.secret AS secret_key FROM deduped d LEFT JOIN (
  SELECT file_path, arg_max(matched_string, lead) AS secret FROM deduped WHERE detector_type = 'AWS_SECRET_KEY' GROUP BY file_path) s ON d.file_path = s.file_path WHERE d.detector_type = 'AWS_ACCESS_KEY'"""))
def aws_pairing_join(spark, sf_dir):
    from ..operators.verify import with_aws_secret

    pairs = with_aws_secret(deduped(spark, sf_dir))
    return pairs.where("detector_type = 'AWS_ACCESS_KEY'").select("file_path", F.col("matched_string").alias("access_key"), F.col("aws_secret").alias("secret_key"))


PRINT = "sha256(replace(file_path, chr(92), '/') || chr(0) || detector_type || chr(0) || redacted)"


@query(upto("scored", f"SELECT file_path, detector_type, redacted, {PRINT} AS fingerprint FROM scored"))
def baseline_fingerprint(spark, sf_dir):
    return found(spark, sf_dir, shown=False).select("file_path", "detector_type", "redacted", baseline.fingerprint().alias("fingerprint"))


def _accepted(rows: DataFrame) -> DataFrame:
    return rows.where("severity = 4").select(baseline.fingerprint().alias("fingerprint"))


@query(upto("scored", f"SELECT file_path, detector_type, redacted, line_number FROM scored WHERE {PRINT} NOT IN (SELECT {PRINT} FROM scored WHERE severity = 4)"))
def baseline_anti_join(spark, sf_dir):
    rows = once(found(spark, sf_dir, shown=False))
    return baseline.suppress(rows, _accepted(rows))[0].select("file_path", "detector_type", "redacted", "line_number")


@query(upto("scored", f"SELECT file_path, detector_type, redacted, line_number FROM scored WHERE {PRINT} NOT IN (SELECT {PRINT} FROM scored WHERE severity = 4)"))
def baseline_table(spark, sf_dir):
    """The same by a table that findings are merged into, behind its Bloom filter."""
    rows, table_ = once(found(spark, sf_dir, shown=False)), shared_folder(spark, "baseline")
    baseline.merge(rows.where("severity = 4"), table_)
    return baseline.suppress(rows, baseline.accepted_table(spark, table_), broadcast_rows=0)[0].select("file_path", "detector_type", "redacted", "line_number")


@query(upto("scored", f"SELECT count(*) AS suppressed FROM scored WHERE {PRINT} IN (SELECT {PRINT} FROM scored WHERE severity = 4)"))
def baseline_suppressed_count(spark, sf_dir):
    rows = once(found(spark, sf_dir, shown=False))
    return baseline.suppress(rows, _accepted(rows))[1].agg(F.count(F.lit(1)).alias("suppressed"))


def _steps() -> str:
    rows = ", ".join(f"({oracle.text(k)}, [{oracle.listed(v)}])" for k, v in remediate.STEPS.items())
    return f"steps(kind, own) AS (VALUES {rows})"


@query(upto("scored", f"""SELECT file_path, redacted, detector_type, array_to_string(list_concat(coalesce(own, [{oracle.listed(remediate.GENERIC)}]), CASE WHEN len(history_commits) > 0 THEN [{oracle.listed(remediate.HISTORY)}] ELSE [] END), ' ') AS steps
  FROM scored LEFT JOIN steps ON kind = detector_type""", _steps()))
def remediation_join(spark, sf_dir):
    return remediate.annotate(found(spark, sf_dir, shown=False)).select("file_path", "redacted", "detector_type", F.array_join("remediation_steps", " ").alias("steps"))


@query(upto("scored", f"""SELECT coalesce(kind, detector_type) AS id, CASE WHEN worst IS NULL OR worst = 1 THEN 'warning' WHEN worst >= 3 THEN 'error' ELSE 'warning' END AS level,
  CASE WHEN worst IS NULL OR worst <= 2 THEN '5.0' WHEN worst = 3 THEN '7.0' ELSE '9.0' END AS security_severity
  FROM (VALUES {", ".join(f"('{s[0]}')" for s in SIGNATURES)}, ('HIGH_ENTROPY')) AS c(kind) FULL JOIN (SELECT detector_type, max(severity) AS worst FROM scored GROUP BY 1) ON kind = detector_type"""))
def sarif_rules(spark, sf_dir):
    return sarif.rules(found(spark, sf_dir)).select("id", "level", "security_severity")


@query(upto("scored", """SELECT ltrim(replace(file_path, chr(92), '/'), '/') AS uri, detector_type AS rule_id, CASE severity WHEN 1 THEN 'note' WHEN 2 THEN 'warning' ELSE 'error' END AS level, greatest(1, line_number)::INTEGER AS start_line,
  sha256(ltrim(replace(file_path, chr(92), '/'), '/') || '|' || detector_type || '|' || redacted) AS secret_hash FROM scored"""))
def sarif_results(spark, sf_dir):
    return sarif.results(found(spark, sf_dir)).select("uri", "rule_id", "level", "start_line", "secret_hash")


@query(upto("scored", f"""SELECT file_path, exposure, CASE WHEN exposure <> 'working_tree' THEN false WHEN file_class = 'env' THEN true WHEN {oracle.EXT} IN ('.pem', '.key') THEN false ELSE {oracle.EXT} IN ({oracle.listed(remediate.REFERENCES)}) END AS fixable, count(*) AS n
  FROM scored GROUP BY ALL"""))
def fixable(spark, sf_dir):
    return remediate.fixable(found(spark, sf_dir)).groupBy("file_path", "exposure", "fixable").agg(F.count(F.lit(1)).alias("n"))


ENV_NAME = f"""CASE WHEN e = '' THEN upper(detector_type) WHEN regexp_matches(e, '^[0-9]') THEN 'SECRET_' || e ELSE e END"""
ENV_LAYER = f"""named AS (SELECT *, upper(trim(regexp_replace(CASE WHEN v <> '' THEN v ELSE detector_type END, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS e FROM (
  SELECT *, regexp_extract(substr(line_content, 1, start_col), {oracle.text(remediate.ASSIGNED)}, 1) AS v FROM deduped))"""


@query(upto("deduped", f"SELECT file_path, line_number, detector_type, {ENV_NAME} AS env_name FROM named", ENV_LAYER))
def env_var_name(spark, sf_dir):
    return deduped(spark, sf_dir).select("file_path", "line_number", "detector_type", remediate.env_name(F.col("line_content"), F.col("start_col"), F.col("detector_type")).alias("env_name"))


_FORMS = " ".join(f"WHEN '{e}' THEN " + " || ".join([oracle.text(form.format(name="\0").split("\0")[0]), ENV_NAME, oracle.text(form.format(name="\0").split("\0")[1])]) for e, form in remediate.REFERENCES.items())


@query(upto("deduped", f"""SELECT file_path, line_number, CASE WHEN regexp_matches(b, '[''"]$') AND regexp_matches(a, '^[''"]') THEN substr(b, 1, length(b) - 1) ELSE b END || CASE {oracle.EXT} {_FORMS} END
  || CASE WHEN regexp_matches(b, '[''"]$') AND regexp_matches(a, '^[''"]') THEN substr(a, 2) ELSE a END AS preview FROM (SELECT *, substr(line_content, 1, start_col) AS b, substr(line_content, end_col + 1) AS a FROM named)""", ENV_LAYER))
def rewrite_preview(spark, sf_dir):
    line, start, end = F.col("line_content"), F.col("start_col"), F.col("end_col")
    name = remediate.env_name(line, start, F.col("detector_type"))
    return deduped(spark, sf_dir).select("file_path", "line_number", remediate.rewrite(line, start, end, name, T.extension(F.col("file_path"))).alias("preview"))


@query(upto("scored", "SELECT count(*) AS leaks FROM scored s JOIN (SELECT DISTINCT file_path, matched_string FROM deduped WHERE length(matched_string) > 8) d ON s.file_path = d.file_path WHERE contains(s.redacted_context, d.matched_string) AND s.redacted = left(d.matched_string, 4) || repeat('*', least(length(d.matched_string) - 4, 20))"))
def leak_check(spark, sf_dir):
    """How many shown lines still hold the secret they are about: 0."""
    rows = once(deduped(spark, sf_dir))
    secrets = rows.where(F.length("matched_string") > 8).select("file_path", "matched_string")  # once for each path
    return score.still_shown(score.scored(rows), secrets).agg(F.count(F.lit(1)).alias("leaks"))


@query(upto("scored", f"SELECT {', '.join(SCORED)} FROM scored").replace(CORPUS_SQL, DOCUMENTS_SQL))
def document_findings(spark, sf_dir):
    """Ranked, redacted findings of the documents table."""
    return score.worst_first(score.scored(dedup.collapse_commits(dedup.line_findings(document_lines(spark, sf_dir))))).select(*SCORED)
