"""Incremental ingest of objects: an extension, since models here are at rest.

Objects arrive as a stream of payloads; each is named by its digest, repeats
within the watermark are dropped, and completeness against a wanted list is a
running aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.objects import digest


def arriving(stream: DataFrame, *, payload: str = "payload", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """digest, logical_len and arrival of each new object."""
    p = F.col(payload)
    rows = stream.select(digest(p).alias("digest"), F.octet_length(p).cast("long").alias("logical_len"), F.col(at).alias("at"))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["digest"])


def completeness(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """A running count of wanted objects and bytes that have arrived."""
    own = objects.join(wanted.select("digest"), "digest", "left_semi")
    return own.groupBy().agg(F.count("*").alias("objects"), F.sum("logical_len").alias("bytes"))


def by_window(objects: DataFrame, width: str = "1 hour") -> DataFrame:
    """Objects and bytes per window of arrival."""
    return objects.groupBy(F.window("at", width)).agg(F.count("*").alias("objects"), F.sum("logical_len").alias("bytes"))


def store(objects: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append new objects to a table; the checkpoint makes each arrive once."""
    return objects.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
