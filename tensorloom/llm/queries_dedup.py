"""Queries of the two dedup operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdup, simhash
from .common import table


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.classes(table(spark, sf_dir, "documents"), shingle=3)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exactdup.groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op3_simhash": op3_simhash, "op9_exact_dedup": op9_exact_dedup}

ORACLE_SQL = {
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """
}
