"""Object stores: tables by digest, directories of files, packs, and repair.

A pack is a Parquet table of objects clustered by digest; its index is the same
table without payloads.  All of it works on any file system that Spark reads.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import objects as O

STRATEGIES = ("linear", "by-tensor", "by-layer", "by-dtype", "by-novelty")
INDEX = ("digest", "otype", "logical_len")


def write_pack(objects: DataFrame, path: str, *, partitions: int | None = None) -> None:
    """Objects once each, ranged and sorted by digest, so that a lookup prunes row groups."""
    once = objects.groupBy("digest", "otype", "logical_len").agg(F.first("payload").alias("payload"))
    ranged = once.repartitionByRange(partitions, "digest") if partitions else once.repartitionByRange("digest")
    ranged.sortWithinPartitions("digest").write.mode("errorifexists").parquet(path)


def open_pack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def index(objects: DataFrame) -> DataFrame:
    """What names objects, without their bytes: payloads are never read."""
    return objects.select(*INDEX)


def find(objects: DataFrame, digests: Sequence[str]) -> DataFrame:
    """Objects by digest; the filter reaches the scan's statistics."""
    return objects.where(F.col("digest").isin(list(digests)))


def directory(spark: SparkSession, path: str, otype: int = 0) -> DataFrame:
    """A directory with one file per digest, the digest being the file's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([0-9a-f]{64})$", 1).alias("digest"), F.lit(otype).alias("otype"), F.col("length").alias("logical_len"), F.col("content").alias("payload")).where("digest <> ''")


def order(tensors: DataFrame, strategy: str, base: DataFrame | None = None) -> DataFrame:
    """(name, digest, rank key) in the order that a strategy lays tensors out.

    by-novelty puts what the base has first, so that a delta's bytes come last.
    """
    layer = F.coalesce(F.regexp_extract("name", r"(\d+)", 1).try_cast("int"), F.lit(-1))
    keys: dict[str, list[Column]] = {
        "linear": [F.col("digest")],
        "by-tensor": [F.col("name"), F.col("seq")],
        "by-layer": [layer, F.col("name"), F.col("seq")],
        "by-dtype": [F.col("dtype"), F.col("name"), F.col("seq")],
        "by-novelty": [F.col("novel"), F.col("name"), F.col("seq")],
    }
    if strategy not in keys:
        raise ValueError(f"no strategy {strategy!r}")
    if strategy == "by-novelty":
        if base is None:
            raise ValueError("by-novelty needs a base")
        known = base.select("digest", F.lit(0).alias("novel")).distinct()
        tensors = tensors.join(known, "digest", "left").withColumn("novel", F.coalesce("novel", F.lit(1)))
    return tensors.orderBy(*keys[strategy])


def fsck(objects: DataFrame) -> DataFrame:
    """Objects whose bytes give their digest, renamed where they do not: digest, was, status."""
    real = O.digest(F.col("payload"))
    status = F.when(F.col("payload").isNull(), "indeterminate").when(real == F.col("digest"), "valid").otherwise("renamed")
    return objects.select(F.coalesce(real, F.col("digest")).alias("digest"), F.col("digest").alias("was"), status.alias("status"))


def recover(spark: SparkSession, path: str, marker: bytes = b"OBJ1") -> DataFrame:
    """Objects found by scanning raw files for records: marker, type, length, CRC-32, bytes.

    A record with a wrong checksum, or cut short, is passed over, and the scan
    goes on at the next marker.
    """

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                at, rows = raw.find(marker), []
                while at >= 0:
                    head = raw[at + len(marker) : at + len(marker) + 14]
                    otype, n, crc = int.from_bytes(head[:2], "little"), int.from_bytes(head[2:10], "little"), int.from_bytes(head[10:14], "little")
                    begin = at + len(marker) + 14
                    body = raw[begin : begin + n]
                    ok = len(head) == 14 and len(body) == n and zlib.crc32(body) == crc
                    if ok:
                        rows.append((file, at, otype, body))
                    at = raw.find(marker, begin + n if ok else at + 1)
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "offset", "otype", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(run, "file string, offset long, otype int, payload binary")
    return found.select(O.digest(F.col("payload")).alias("digest"), "otype", F.octet_length("payload").cast("long").alias("logical_len"), "payload", "file", "offset")


def record(payload: bytes, otype: int = 0, marker: bytes = b"OBJ1") -> bytes:
    """One record as ``recover`` reads it."""
    return marker + otype.to_bytes(2, "little") + len(payload).to_bytes(8, "little") + zlib.crc32(payload).to_bytes(4, "little") + payload


def export_objects(objects: DataFrame, path: str) -> None:
    """Payloads by type, for tools that read plain tables."""
    objects.select("digest", "otype", "payload").repartition("otype").write.partitionBy("otype").parquet(path)


def read_cost(deps: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks and bytes that a partial read touches, of all: source, chunks, bytes, of_bytes.

    deps: source, low, high; chunks: source, seq, low, high, bytes.
    """
    met = chunks.alias("c").join(deps.alias("d"), (F.col("c.source") == F.col("d.source")) & (F.col("c.low") < F.col("d.high")) & (F.col("d.low") < F.col("c.high")), "left_semi")
    total = chunks.groupBy("source").agg(F.sum("bytes").alias("all"))
    return met.groupBy("source").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes")).join(total, "source").select("source", "chunks", "bytes", (F.col("bytes") / F.col("all")).alias("of_bytes"))
