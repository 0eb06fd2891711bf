"""Shared helpers: the cluster's shared folder, staged tables, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step works on at a time.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch: documents can be long, and a batch is held whole on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by ``BATCH_ROWS``, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    It is read from ``spark.checkpoint.dir`` (or the context's checkpoint
    directory).  Only where neither is set and all executors are threads of the
    driver, as in local tests, a temporary one is made and set; on a cluster
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else ""
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tensorloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of a file of a narrow staged table at least, where its row count is known.
FILE_ROWS = 1 << 17


def staged(df: DataFrame, tag: str, *, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage: a later failure reads it again instead
    of computing it anew, whichever executor is lost.  ``rows``, a bound of the
    rows of a narrow table, keeps small tables from being written by as many
    tasks as large ones: there is one task for ``FILE_ROWS`` of them at most.
    """
    path = fresh_dir(small_batches(df.sparkSession), tag)
    if rows is not None:
        df = df.coalesce(-(-rows // FILE_ROWS) or 1)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


class Tables:
    """Staged tables of one piece of work, deleted together when its result is written."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def staged(self, df: DataFrame, tag: str, **options) -> DataFrame:
        self.held.append(staged(df, tag, **options))
        return self.held[-1]

    def release(self) -> None:
        release(*self.held)
        self.held = []


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: what came of them is written."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on after its task, beside a full JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of column ``text`` stay near ``most``.

    Rows are never cut; one row larger than ``most`` comes alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        yield batch.slice(begin)
        del batch
        give_back()


def with_fields(df: DataFrame, **types: str):
    """The schema of ``df`` and more fields of the given types."""
    from pyspark.sql import types as T

    more = T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in types.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have."""
    held, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


#: Bits of a screen at most, and for each listed key.  A screen is broadcast: 64 bits a row, so 2**18 rows at most.
SCREEN_BITS, BITS_A_KEY = 1 << 24, 32


def screened(df: DataFrame, key: Column, listed: DataFrame, hashed: Column, flag: str) -> DataFrame:
    """``df`` with a column that is false only where ``key`` (a 64-bit hash) is not among ``hashed`` of ``listed``.

    The screen is one bit table of bounded size, whatever the number of keys, so
    it can be broadcast; what it lets through has to be joined all the same.
    ``listed`` is read twice and should be a written table.
    """
    wanted = max(64, BITS_A_KEY * listed.count())
    bits = min(SCREEN_BITS, 1 << (wanted - 1).bit_length())
    mixed = F.pmod(F.xxhash64(hashed), F.lit(bits))
    words = listed.select(mixed.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_m"))
    word, mask, bit = free_names(df, "word", "mask", "bit")
    words = words.select(F.col("_w").alias(word), F.col("_m").alias(mask))
    marked = df.withColumn(bit, F.pmod(F.xxhash64(key), F.lit(bits)))
    met = marked.join(F.broadcast(words), F.shiftright(F.col(bit), 6) == F.col(word), "left")
    hit = F.expr(f"(shiftrightunsigned(coalesce(`{mask}`, 0L), cast(`{bit}` & 63 as int)) & 1L) = 1L")
    return met.withColumn(flag, hit).drop(word, mask, bit)


def without(df: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``df`` whose ``keys`` are not among those of ``gone``; nulls are equal.

    ``keys`` maps each column of ``gone``, a written table, to an expression over
    ``df``.  A screen lets most rows stay where they are, and only the few that
    may be listed are joined, so whole texts are not dealt anew.  The columns of
    ``df`` come back as they are, whatever their names.
    """
    (flag,) = free_names(df, "maybe")
    own = free_names(df, *(f"own_{k}" for k in keys))
    other = free_names(df, *(f"gone_{k}" for k in keys))
    marked = df.withColumns(dict(zip(own, keys.values(), strict=True)))
    listed = gone.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)))
    marked = screened(marked, F.xxhash64(*own), listed, F.xxhash64(*other), flag)
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, other, strict=True)]
    left = marked.where(F.col(flag)).join(listed, functools.reduce(lambda a, b: a & b, same), "left_anti")
    return marked.where(~F.col(flag)).union(left).drop(*own, flag)
