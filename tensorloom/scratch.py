"""Tables written to the cluster's shared folder, which cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where all executors are threads of the driver."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not place and (held := context._jsc.sc().getCheckpointDir()).isDefined():
        place = held.get()
    if not place:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="tensorloom-")
        context.setCheckpointDir(place)
    return place.rstrip("/")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table: a lost executor costs a re-read, not a recomputation."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
