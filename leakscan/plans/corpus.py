"""Lines to scan, made from the tables by SQL that Spark and DuckDB both run: a synthetic history with secrets of every type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import settled, spread

Q = "chr(39)"
# k: order key; two neighbouring keys share their secret, path and kind of line, and differ in commit and line number
KEYED = """
SELECT o_orderkey AS k, o_orderkey - o_orderkey % 2 AS g, md5(CAST(o_orderkey - o_orderkey % 2 AS STRING)) AS m,
  md5('x' || CAST(o_orderkey - o_orderkey % 2 AS STRING)) AS w FROM orders"""
LINE = f"""CASE (g / 2) % 24
  WHEN 0 THEN 'key_id = AKIA' || upper(substr(m, 1, 16))
  WHEN 1 THEN 'aws_secret_access_key = "' || substr(m || w, 1, 40) || '"'
  WHEN 2 THEN 'API_KEY: "' || substr(m, 1, 24) || '"'
  WHEN 3 THEN 'token = ' || {Q} || m || {Q}
  WHEN 4 THEN 'password = "Pw!' || substr(m, 1, 9) || '"'
  WHEN 5 THEN 'slack: xo' || 'xb-' || substr(m, 1, 24)
  WHEN 6 THEN 'post("https://hooks.slack' || '.com/services/T' || upper(substr(m, 1, 9)) || '/B' || upper(substr(m, 10, 9)) || '/' || substr(w, 1, 24) || '")'
  WHEN 7 THEN '-----BEGIN ' || CASE WHEN g % 3 = 0 THEN 'RSA ' WHEN g % 3 = 1 THEN 'EC ' ELSE '' END || 'PRIVATE KEY-----'
  WHEN 8 THEN 'url: postgres://app:' || substr(m, 1, 10) || '@db.internal.net/main'
  WHEN 9 THEN 'bearer ey' || 'J' || substr(m, 1, 20) || '.' || substr(w, 1, 20) || '.' || substr(m, 5, 20)
  WHEN 10 THEN 'gh' || 'p_' || substr(m || w, 1, 36)
  WHEN 11 THEN 'maps AI' || 'za' || substr(w || m, 1, 35)
  WHEN 12 THEN 'charge(sk_' || 'live_' || substr(m, 1, 24) || ')'
  WHEN 13 THEN 'secret = "your_api_key_here"'
  WHEN 14 THEN 'password: "change' || 'me"'
  WHEN 15 THEN 'AUTH_TOKEN=' || m
  WHEN 16 THEN 'client.login("' || m || '", credential, ' || {Q} || '/static/path/of/it' || {Q} || ')'
  WHEN 17 THEN 'token = "xyxyxyxyxyxyxyxy"'
  WHEN 18 THEN 'token = "' || m || '"; password = "' || substr(w, 1, 12) || '"'
  WHEN 19 THEN '  secret: "' || w || '", key_name: "' || substr(m, 1, 13) || '"  '
  WHEN 20 THEN 'db_password = os.environ["DB_PASSWORD_' || substr(m, 1, 6) || '"]'
  WHEN 21 THEN 'the quick brown fox ' || m
  WHEN 22 THEN 'colour = "#a1b2c3", id_key = "' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '"'
  ELSE 'for i in range(10): pass' END"""
PATH = """CASE (g / 2) % 7
  WHEN 0 THEN 'deploy/' || CAST(g % 97 AS STRING) || '/.env'
  WHEN 1 THEN 'config/app' || CAST(g % 97 AS STRING) || '.yml'
  WHEN 2 THEN 'src\\mod' || CAST(g % 97 AS STRING) || '.py'
  WHEN 3 THEN 'tests/test_' || CAST(g % 97 AS STRING) || '.py'
  WHEN 4 THEN 'docs/page' || CAST(g % 97 AS STRING) || '.md'
  WHEN 5 THEN 'Makefile' ELSE 'src/web/m' || CAST(g % 97 AS STRING) || '.ts' END"""
# DuckDB's / divides integers into doubles, so whole division is written as a floor in both
LINES = f"""SELECT {PATH} AS file_path, CASE WHEN k % 3 = 0 THEN NULL ELSE substr(md5('c' || CAST(k % 50 AS STRING)), 1, 12) END AS commit_hash,
  CAST(k AS INT) AS line_number, {LINE} AS line_content, CAST(k AS BIGINT) AS seq FROM ({KEYED}) AS keyed""".replace("(g / 2)", "CAST(floor(g / 2) AS BIGINT)")
DOCUMENTS = """SELECT 'documents/' || CAST(doc_id AS STRING) AS file_path, CAST(NULL AS STRING) AS commit_hash, CAST(n AS INT) AS line_number, line AS line_content, 1125899906842624 + CAST(doc_id AS BIGINT) * 1000000 + n AS seq"""


#: A line number that several rows of a path and commit share, for the pass that groups by lines.
SHARED_LINES = ("CAST(k AS INT) AS line_number", "CAST(k % 400 + 1 AS INT) AS line_number")


def orders_lines(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    keys = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    sql = LINES.replace("FROM orders", "FROM {keys}").replace("\\", "\\\\")
    # a line is made once, not again by every filter on it
    return settled(spark.sql(sql.replace(*SHARED_LINES) if shared else sql, keys=keys))


def text_lines(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """Lines of a table with a text column, one file for each key; null texts have none."""
    name = F.concat(F.lit(path + "/"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    at = F.posexplode(F.split("text", "\n")).alias("n", "line_content")
    rows = df.where(F.col("text").isNotNull()).select(name.alias("file_path"), F.col(keys[0]).cast("bigint").alias("key"), at)
    return rows.select("file_path", F.lit(None).cast("string").alias("commit_hash"), (F.col("n") + 1).alias("line_number"), "line_content", (F.lit(1 << 50) + F.col("key") * 1_000_000 + F.col("n") + 1).alias("seq"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents", "doc_id")


def corpus(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    return orders_lines(spark, sf_dir, shared).unionByName(document_lines(spark, sf_dir))


DOCUMENTS_SQL = f"""lines AS ({DOCUMENTS} FROM (SELECT doc_id, unnest(range(1, len(t) + 1)) AS n, unnest(t) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"""
CORPUS_SQL = f"""lines AS ({LINES}
  UNION ALL {DOCUMENTS_SQL.removeprefix("lines AS (")}"""
