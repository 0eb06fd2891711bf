"""Training-order materialisation of token ids.

Every input partition turns its documents into sequences of fixed length, which
are numbered densely over all partitions.  A keyed Feistel network over the
numbers, with cycle-walking back into the range, gives each sequence its global
slot: a permutation that needs no table and can be computed, and inverted, for
any one number.  Slots are cut into ranges; each range is one shard file of
records with a fixed stride, so that slot ``s`` lies in shard ``s // per`` at
byte ``(s % per) * stride``, and a reader can stop and resume anywhere.

A record is the number of its ids (unsigned 32 bits), the ids (unsigned 16 or
32 bits, zero where unused) and four zero bytes, all little-endian.  Shards are
written by Spark's text sink, whose line end is one zero byte: a record's last.

Defined cases: a null or empty text is its end id alone.  Repeated rows give
their ids again.  A very long text runs over as many sequences as it needs.  The
last sequence of a partition may be short.  Slots have no ties: the order is a
permutation.  An empty table gives no shard and an empty result.  Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import mix
from .common import fresh_dir, slices, staged
from .tokens import END_ID, Encoder, tokenizer_path

LENGTH = 2048
KEY = 20_240_101
ROUNDS = 6
#: Slots of a shard at most; small inputs are cut into about ``LEAST_SHARDS``.
SLOTS, LEAST_SHARDS = 1 << 15, 64
U64 = np.uint64


class Feistel:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = U64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key))

    def _round(self, right: np.ndarray, key) -> np.ndarray:
        return mix(right ^ key) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        if back:
            for key in self.keys[::-1]:
                left, right = right ^ self._round(left, key), left
        else:
            for key in self.keys:
                left, right = right, left ^ self._round(right, key)
        return (left << U64(self.half)) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(U64), back)
        while len(far := np.flatnonzero(out >= U64(self.n))):
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def write(documents: DataFrame, target: str | None = None, *, ident: str = "doc_id", text: str = "text", length: int = LENGTH, key: int = KEY, tokenizer: str | None = None) -> str:
    """Write the shards and their manifest; returns the path."""
    spark = documents.sparkSession
    target = target or fresh_dir(spark, "ordered")
    path = tokenizer or tokenizer_path()

    def cut(batches):
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        kind = np.dtype("<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        packer = zstandard.ZstdCompressor(level=3)
        held, local = np.zeros(0, dtype=kind), 0

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "local", "ids"])

        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            end = np.asarray([END_ID], dtype=kind)
            parts = [held]
            for ids in encoder.encode(texts):
                parts += [np.frombuffer(ids, dtype="<u4").astype(kind), end]
            held = np.concatenate(parts)
            whole = len(held) - len(held) % length
            rows = [(local + k, packer.compress(held[at : at + length].tobytes())) for k, at in enumerate(range(0, whole, length))]
            local, held = local + len(rows), held[whole:]
            yield out(rows)
        if len(held):
            yield out([(local, packer.compress(held.tobytes()))])

    rows = documents.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = staged(rows.select("text").mapInArrow(cut, "part long, local long, ids binary"), "sequences", codec="none")
    # One row per input partition.
    counts = sorted((r.part, r.n) for r in pieces.groupBy("part").agg(F.count("*").alias("n")).collect())
    names, sizes = np.array([c[0] for c in counts], dtype=np.int64), np.array([c[1] for c in counts], dtype=np.int64)
    before, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    wide = 2 if Encoder.of(path).tokenizer.get_vocab_size() <= 1 << 16 else 4
    per = max(1, min(SLOTS, -(-n // LEAST_SHARDS)))
    head = {"sequences": n, "length": length, "slots_per_shard": per, "id_bytes": wide, "stride": length * wide + 8, "key": key}
    order = Feistel(max(n, 1), key)

    @F.arrow_udf("long")
    def slot(part: pa.Array, local: pa.Array) -> pa.Array:
        number = before[np.searchsorted(names, part.to_numpy(zero_copy_only=False))] + local.to_numpy(zero_copy_only=False)
        return pa.array(order.slot(number))

    def record(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                out = []
                for ids in part.column("ids").to_pylist():
                    raw = unpacker.decompress(ids)
                    out.append((len(raw) // wide).to_bytes(4, "little") + raw.ljust(length * wide, b"\0") + b"\0\0\0")
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("slot"), pa.array(out, pa.binary())], ["shard", "slot", "record"])

    dealt = pieces.select(slot("part", "local").alias("slot"), "ids").withColumn("shard", F.floor(F.col("slot") / per).cast("int"))
    dealt = dealt.repartitionById(max(1, -(-n // per)), "shard").select("shard", "slot", "ids")  # a task a range
    records = dealt.mapInArrow(record, "shard int, slot long, record binary").sortWithinPartitions("shard", "slot")
    value = F.col("record").cast("string").alias("value")
    records.select("shard", value).write.partitionBy("shard").option("lineSep", "\0").option("compression", "none").text(f"{target}/data.tmp")
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{target}/manifest.tmp")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in ("data", "manifest"):  # the manifest last
        if not fs.rename(hadoop(f"{target}/{name}.tmp"), hadoop(f"{target}/{name}")):
            raise OSError(f"{target}/{name} is there already")
    return target


def manifest(spark: SparkSession, target: str) -> dict:
    return json.loads(spark.read.text(f"{target}/manifest").first()[0])


def read(spark: SparkSession, target: str, *, start: int = 0, ids: bool = True) -> DataFrame:
    """Records from slot ``start`` on: slot, shard, byte_offset, number, n_ids, ids_crc32, ids.

    ``number`` is the sequence's own number, from the inverse permutation.
    Shards before ``start`` are not opened.
    """
    head = manifest(spark, target)
    schema = "slot long, shard int, byte_offset long, number long, n_ids long, ids_crc32 long, ids binary"
    if not head["sequences"]:
        return spark.createDataFrame([], schema)
    per, stride, wide = head["slots_per_shard"], head["stride"], head["id_bytes"]
    order = Feistel(head["sequences"], head["key"])

    def run(batches):
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                view = memoryview(raw.as_buffer())
                if len(view) % stride:
                    raise ValueError(f"shard {shard} is cut short")
                first = max(0, start - shard * per)
                slots = np.arange(shard * per + first, shard * per + len(view) // stride)
                for begin in range(0, len(slots), 500):
                    part = slots[begin : begin + 500]
                    rows = []
                    for s in part.tolist():
                        at = (s - shard * per) * stride
                        n = int.from_bytes(view[at : at + 4], "little")
                        body = view[at + 4 : at + 4 + n * wide]
                        rows.append((at, n, zlib.crc32(body), bytes(body) if ids else None))
                    columns = list(zip(*rows, strict=True))
                    numbers = order.number(part)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([shard] * len(part), pa.int32()), pa.array(columns[0], pa.int64()), pa.array(numbers), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["slot", "shard", "byte_offset", "number", "n_ids", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").load(f"{target}/data")
    return files.where(F.col("shard") >= start // per).select(F.col("shard").cast("int"), "content").mapInArrow(run, schema)
