"""What changed between two versions of a tensor, and how to store it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..functions.rows import runs
from ..scratch import written
from ..tensor import TensorRef
from .contract import dense, tiled

#: A lossy delta must be smaller than this part of the best lossless one (fixed value).
LOSSY_GAIN = 0.75
CHAIN_LIMIT = 32


def apply(base: TensorRef, patch: TensorRef, op: str) -> TensorRef:
    """add, sparse-add, replace or xor a patch; absent cells of a sparse one keep the base."""
    from .elementwise import xor

    if op == "xor":
        return xor(base, patch)
    both = base.cells().join(patch.cells().withColumnRenamed("v", "p"), "pos", "left")
    match op:
        case "add" | "sparse-add":
            v = F.col("v") + F.coalesce("p", S.lit(0))
        case "replace":
            v = F.coalesce("p", "v")
        case _:
            raise ValueError(f"no delta {op!r}")
    return base.with_cells(both.select("pos", v.alias("v"))).rounded()


def _round_away(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def analyze(base: DataFrame, tuned: DataFrame, *, bytes_per: int = 4, chunk: int = 65536, bound: float = 0.0, levels: int = 127) -> DataFrame:
    """The cheapest representation of every tensor's change.

    Both frames have tensor, pos and v.  Candidates are identical, chunk (the
    changed chunks whole), sparse (8-byte places and values), residual (one
    byte a cell, if its error is within ``bound``) and full.  Returns tensor,
    kind, bytes, max_error, changed and n.
    """
    both = base.withColumnRenamed("v", "b").join(tuned.withColumnRenamed("v", "t"), ["tensor", "pos"], "full")
    same = F.col("b").eqNullSafe(F.col("t"))
    d = F.coalesce("t", S.lit(0)) - F.coalesce("b", S.lit(0))
    both = both.withColumn("d", d).withColumn("ch", F.when(~same, 1).otherwise(0)).withColumn("chunk", F.expr(f"pos div {chunk}L"))
    parts = both.groupBy("tensor", "chunk").agg(F.sum("ch").alias("changed"), F.count("*").alias("n"), F.max(F.abs("d")).alias("top"), F.count_if(F.col("b").isNull() | F.col("t").isNull()).alias("odd"))
    whole = parts.groupBy("tensor").agg(
        F.sum("changed").alias("changed"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("changed") > 0, F.col("n")).otherwise(0)).alias("in_chunks"),
        F.max("top").alias("top"),
        F.sum("odd").alias("odd"),
    )
    n = F.col("n")
    step = F.col("top") / (2 * levels)
    costs = [
        F.struct(F.when((F.col("changed") == 0), F.lit(0)).cast("long").alias("bytes"), F.lit(0).alias("turn"), F.lit("identical").alias("kind"), S.lit(0).alias("max_error")),
        F.struct(F.when(F.col("odd") == 0, F.col("in_chunks") * bytes_per).cast("long").alias("bytes"), F.lit(1).alias("turn"), F.lit("chunk").alias("kind"), S.lit(0).alias("max_error")),
        F.struct(F.when(F.col("odd") == 0, F.col("changed") * (8 + bytes_per)).cast("long").alias("bytes"), F.lit(2).alias("turn"), F.lit("sparse").alias("kind"), S.lit(0).alias("max_error")),
        F.struct((n * bytes_per).cast("long").alias("bytes"), F.lit(4).alias("turn"), F.lit("full").alias("kind"), S.lit(0).alias("max_error")),
    ]
    best = F.array_min(F.filter(F.array(*costs), lambda c: c["bytes"].isNotNull()))
    residual = (n + 8).cast("long")
    lossy = (F.col("odd") == 0) & (F.col("changed") > 0) & (step <= bound) & (residual < best["bytes"] * LOSSY_GAIN)
    out = whole.withColumn("best", best).withColumn("lossy", lossy)
    return out.select(
        "tensor",
        F.when(F.col("lossy"), "residual").otherwise(F.col("best.kind")).alias("kind"),
        F.when(F.col("lossy"), residual).otherwise(F.col("best.bytes")).alias("bytes"),
        F.when(F.col("lossy"), step).otherwise(S.lit(0)).alias("max_error"),
        "changed",
        "n",
    )


def residual(base: TensorRef, tuned: TensorRef, levels: int = 127) -> DataFrame:
    """(pos, q, s): the change in whole steps, halves away from zero."""
    both = base.cells().join(tuned.cells().withColumnRenamed("v", "t"), "pos").withColumn("d", F.col("t") - F.col("v"))
    top = both.agg((F.max(F.abs("d")) / levels).alias("s"))  # one row
    s = F.when(F.col("s") == 0, S.lit(1)).otherwise(F.col("s"))
    return both.crossJoin(F.broadcast(top)).select("pos", _round_away(F.col("d") / s).alias("q"), s.alias("s"))


def report(analysis: DataFrame, bytes_per: int = 4) -> DataFrame:
    """Per kind: tensors, bytes, the largest error, and the share of the base's bytes."""
    return analysis.groupBy("kind").agg(F.count("*").alias("tensors"), F.sum("bytes").alias("bytes"), F.max("max_error").alias("max_error"), (F.sum("bytes") / (F.sum("n") * bytes_per)).alias("of_base"))


#: How a value of each type is stored (fixed values): NumPy's name of it, little-endian.
STORED = {"f64": "<f8", "f32": "<f4", "f16": "<f2", "i8": "<i1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "u8": "<u1", "u16": "<u2", "u32": "<u4", "u64": "<u8"}


#: Places whose bytes are packed together before a digest runs over them.
PIECE = 1 << 16


def chunk_digests(cells: DataFrame, *, chunk: int = 65536, to: str = "f64") -> DataFrame:
    """(tensor, seq, digest): SHA-256 of fixed-size chunks' bytes, the values in order as ``to`` stores them.

    Tasks sort cells and pack them into pieces; a chunk of several pieces then
    takes one task, which sorts the pieces' bytes only.  A null counts as NaN.
    """
    stored = STORED[to]

    def pack(batches):
        for (tensor, seq, piece), (_, values) in runs(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array([tensor], pa.string()), pa.array([seq], pa.int64()), pa.array([piece], pa.int64()), pa.array([values.astype(stored).tobytes()], pa.binary())], ["tensor", "seq", "piece", "raw"])

    def digests(batches):
        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["tensor", "seq", "digest"])

        now = state = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for key, raw in zip(keys, batch.column(3), strict=True):
                if key != now:
                    if state:
                        yield row()
                    now, state = key, hashlib.sha256()
                state.update(raw.as_buffer())
        if state:
            yield row()

    def single(batches):
        out = []
        for (tensor, seq, _), (_, values) in runs(batches, 3):
            out.append((tensor, seq, hashlib.sha256(values.astype(stored).tobytes()).hexdigest()))
            if len(out) >= 1000:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["tensor", "seq", "digest"])

    piece = F.expr(f"pos div {PIECE}L") if chunk > PIECE else F.lit(0).cast("long")
    rows = cells.select(F.col("tensor").cast("string").alias("tensor"), F.expr(f"pos div {chunk}L").alias("seq"), piece.alias("piece"), "pos", F.col("v").cast("double").alias("v"))
    placed = rows.repartition("tensor", "seq", "piece").sortWithinPartitions("tensor", "seq", "piece", "pos")
    if chunk <= PIECE:
        return placed.mapInArrow(single, "tensor string, seq long, digest string")
    pieces = placed.mapInArrow(pack, "tensor string, seq long, piece long, raw binary")
    return pieces.repartition("tensor", "seq").sortWithinPartitions("tensor", "seq", "piece").mapInArrow(digests, "tensor string, seq long, digest string")


def verify_range(cells: DataFrame, digests: DataFrame, low: int, high: int, *, chunk: int = 65536) -> DataFrame:
    """(tensor, seq, status) of the chunks that a range touches; no other chunk is read.

    A chunk without a recorded digest is indeterminate.
    """
    first, last = low // chunk * chunk, -(-high // chunk) * chunk
    own = chunk_digests(cells.where((F.col("pos") >= first) & (F.col("pos") < last)), chunk=chunk)
    both = own.join(digests.withColumnRenamed("digest", "was"), ["tensor", "seq"], "left")
    status = F.when(F.col("was").isNull(), "indeterminate").when(F.col("was") == F.col("digest"), "valid").otherwise("invalid")
    return both.select("tensor", "seq", status.alias("status"))


def materialized(cells: DataFrame, declared: DataFrame, *, to: str = "f64") -> DataFrame:
    """(tensor, status): whether a tensor's encoded bytes give its declared digest (R-T08).

    A digest runs over a tensor from its first byte to its last, so each tensor
    streams through one task.
    """
    whole = chunk_digests(cells, chunk=1 << 62, to=to).drop("seq")
    both = declared.withColumnRenamed("digest", "was").join(whole, "tensor", "left")
    status = F.when(F.col("digest").isNull(), "indeterminate").when(F.col("was") == F.col("digest"), "valid").otherwise("invalid")
    return both.select("tensor", status.alias("status"))


def chunk_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chunks that differ: tensor, seq, status (changed, added, removed)."""
    both = a.withColumnRenamed("digest", "da").join(b.withColumnRenamed("digest", "db"), ["tensor", "seq"], "full")
    status = F.when(F.col("da").isNull(), "added").when(F.col("db").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("da").eqNullSafe(F.col("db"))).select("tensor", "seq", status.alias("status"))


def diff(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Per tensor: identical, changed, added or removed, with the largest and mean change."""
    both = base.withColumnRenamed("v", "b").join(tuned.withColumnRenamed("v", "t"), ["tensor", "pos"], "full")
    got = both.groupBy("tensor").agg(F.count("b").alias("nb"), F.count("t").alias("nt"), F.max(F.abs(F.col("t") - F.col("b"))).alias("max_change"), F.avg(F.abs(F.col("t") - F.col("b"))).alias("mean_change"), F.count_if(~F.col("b").eqNullSafe(F.col("t"))).alias("changed"))
    status = F.when(F.col("nb") == 0, "added").when(F.col("nt") == 0, "removed").when(F.col("changed") == 0, "identical").otherwise("changed")
    return got.select("tensor", status.alias("status"), "changed", "max_change", "mean_change")


#: Rows of a block that is factored at once, at most.
FACTORED_ROWS = 4096


def low_rank(changes: DataFrame, rows: int, columns: int, rank: int) -> DataFrame:
    """Factors of each tensor's change: its largest singular values with their vectors.

    ``changes`` has tensor, pos and v; returns tensor, k, sigma, side, i and x.
    Blocks of the longer side are reduced to triangles of the shorter side's
    extent by QR, and triangles to one, whose singular values are the tensor's
    own; vectors of the longer side are products of the blocks.  So a task holds
    a block and a square of the shorter side.  A value of zero has a zero vector
    on the longer side.
    """
    long, short, names = (rows, columns, "uv") if rows >= columns else (columns, rows, "vu")
    count = min(rank, short)
    block = min(long, max(256, min(FACTORED_ROWS, (32 << 20) // (8 * short))))
    i, j = F.expr(f"pos div {columns}L"), F.col("pos") % columns
    if rows < columns:
        i, j = j, i
    cells = changes.select(F.col("tensor").cast("string").alias("tensor"), i.alias("i"), j.alias("j"), F.col("v").cast("double").alias("v"))
    tiles = tiled(cells, F.col("i"), F.col("j"), "v", ["tensor"], block, short, key="string").select("tensor", "ti", "cells")

    def row(tensor, raw):
        return pa.RecordBatch.from_arrays([pa.array([tensor], pa.string()), pa.array([raw], pa.binary())], ["tensor", "raw"])

    def triangle(held, more):
        return np.linalg.qr(more if held is None else np.concatenate([held, more]), mode="r")

    def triangles(batches):
        """The triangle of each tensor's blocks in a partition."""
        now = held = None
        for batch in batches:
            for tensor, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if tensor != now:
                    if now is not None:
                        yield row(now, held.tobytes())
                    now, held = tensor, None
                held = triangle(held, dense(raw.as_buffer(), block, short, short))
        if now is not None:
            yield row(now, held.tobytes())

    def values(batches):
        """Singular values and the shorter side's vectors, as columns, of each tensor."""

        def out():
            _, sigmas, right = np.linalg.svd(held, full_matrices=False)
            sigmas = np.append(sigmas, np.zeros(max(0, count - len(sigmas))))[:count]
            right = np.concatenate([right, np.zeros((max(0, count - len(right)), short))])[:count]
            return row(now, np.concatenate([sigmas[:, None], right], axis=1).tobytes())

        now = held = None
        for batch in batches:
            for tensor, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if tensor != now:
                    if now is not None:
                        yield out()
                    now, held = tensor, None
                held = triangle(held, np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, short))
        if now is not None:
            yield out()

    def entries(tensor, side, sigmas, first, x):
        """x has a column for each singular value."""
        n = len(x)
        ks = np.repeat(np.arange(count, dtype=np.int32), n)
        return pa.RecordBatch.from_arrays([pa.array([tensor] * n * count, pa.string()), pa.array(ks), pa.array(np.repeat(sigmas, n)), pa.array([side] * n * count, pa.string()), pa.array(np.tile(np.arange(first, first + n, dtype=np.int32), count)), pa.array(x.T.ravel())], ["tensor", "k", "sigma", "side", "i", "x"])

    def vectors(batches):
        for batch in batches:
            for tensor, ti, raw, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                both = np.frombuffer(raw.as_buffer(), "<f8").reshape(count, short + 1)
                sigmas, right = both[:, 0], both[:, 1:].T
                if ti == 0:
                    yield entries(tensor, names[1], sigmas, 0, right)
                n = min(block, long - ti * block)
                x = dense(cells.as_buffer(), n, short, short) @ right if cells.is_valid else np.zeros((n, count))
                safe = sigmas > np.finfo(float).eps * long * sigmas.max(initial=0)
                yield entries(tensor, names[0], sigmas, ti * block, np.where(safe, x / np.where(safe, sigmas, 1.0), 0.0))

    parts = tiles.sortWithinPartitions("tensor").mapInArrow(triangles, "tensor string, raw binary")
    found = parts.repartition("tensor").sortWithinPartitions("tensor").mapInArrow(values, "tensor string, raw binary")
    each = found.select("tensor", F.explode(F.sequence(F.lit(0), F.lit(-(-long // block) - 1))).alias("ti"), "raw")
    return each.join(tiles, ["tensor", "ti"], "left").select("tensor", "ti", "raw", "cells").mapInArrow(vectors, "tensor string, k int, sigma double, side string, i int, x double")


def resolve_chain(parents: DataFrame, start: str, limit: int = CHAIN_LIMIT) -> DataFrame:
    """(depth, digest, status) from ``start`` up its parents.

    ``parents`` has digest, parent and required.  A parent that is absent
    makes the chain incomplete only if it is required; more than ``limit``
    links are an error.  Ancestors double with each join, so a chain of n
    links takes log n of them, and one small result.
    """
    links = parents.select("digest", "parent", "required")
    spark = parents.sparkSession
    reach = written(links.where("parent is not null").select(F.col("digest").alias("lower"), F.col("parent").alias("upper"), F.lit(1).alias("n")), "links")
    found = spark.createDataFrame([(start, 0)], "digest string, depth int")
    steps = 1
    while steps <= limit + 1:
        far = found.join(reach, F.col("digest") == F.col("lower")).select(F.col("upper").alias("digest"), (F.col("depth") + F.col("n")).alias("depth"))
        found = written(found.unionByName(far), "chain")  # depths below 2 * steps
        if (most := found.agg(F.max("depth")).first()[0]) < steps or most > limit:
            break
        a, b = reach.alias("a"), reach.alias("b")
        reach = written(a.join(b, F.col("a.upper") == F.col("b.lower")).select("a.lower", "b.upper", (F.col("a.n") + F.col("b.n")).alias("n")), "links")
        steps *= 2
    if most > limit:
        raise ValueError(f"more than {limit} parents")
    own = found.join(links, "digest", "left")
    needs = own.select((F.col("depth") + 1).alias("depth"), F.col("required").alias("needed"))
    known = parents.select(F.col("digest").alias("known")).distinct()
    told = own.select("depth", "digest").join(known, F.col("digest") == F.col("known"), "left").join(needs, "depth", "left")
    status = F.when(F.col("known").isNotNull(), "present").when(F.coalesce("needed", F.lit(False)), "incomplete").otherwise("absent")
    return told.select("depth", "digest", status.alias("status"))
