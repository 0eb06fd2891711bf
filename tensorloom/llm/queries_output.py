"""Queries of the operators that write sequences or archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import order, packing, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, target, payload=False).drop("payload", "url")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = order.write(table(spark, sf_dir, "documents"))
    return order.read(spark, target, ids=False).drop("ids")


QUERIES = {"op1_warc": op1_warc, "op2_packing": op2_packing, "op4_order": op4_order}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 of 40 hex digits: five digits are four letters.
_BASE32 = f"array_to_string(list_transform(generate_series(0, 31), lambda i: substr('{_LETTERS}', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + (i // 4) * 5 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '')"

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
        FROM p
    """
}
