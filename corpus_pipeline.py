"""The corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, packing, in this order.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of
documents; the last returns the pieces of the packed sequences.

Nulls: null and empty texts have too few words and go with the quality rules; a null id is kept like any other by all stages (the
near duplicates take it for a document without copies). Rows that are equal go or stay together, and are packed one by one.
Empty tables give no rows. Further columns stay until the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leakscan.llm.common import table, written
from leakscan.llm.decontam import drop_leaks
from leakscan.llm.jaccard import JoinRules, drop_near_duplicates
from leakscan.llm.packing import pack_documents
from leakscan.llm.quality import keep_good
from leakscan.llm.queries import tokenizer_path
from leakscan.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard similarity from 0.8) the one with the smallest id stays."""
    return drop_near_duplicates(docs, JoinRules(k=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1024."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]
ORACLE_SQL = None  # tokens, near duplicates by groups and edit distances are beyond SQL; the tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
