"""Quantization: formulas, block grids, codebooks, requantization, packed words."""

from __future__ import annotations

import statistics
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..functions.dtypes import DType, dtype, round_through
from ..tensor import TensorRef, position, size
from .structure import gather

FORMULAS = ("affine-sub", "affine-add", "sym", "codebook", "codebook-raw", "nested")


@dataclass(frozen=True)
class Scheme:
    """How integers stand for numbers.

    ``block`` is the tile that shares parameters (none: the whole tensor).
    """

    formula: str
    q: str = "i8"
    block: tuple[int, ...] | None = None
    out: str = "f64"
    clip: tuple[float, float] | None = None
    order: tuple[int, ...] | None = None

    def __post_init__(self):
        if self.formula not in FORMULAS:
            raise ValueError(f"no formula {self.formula!r}")

    @property
    def range(self) -> tuple[float, float]:
        t = dtype(self.q)
        return t.smallest, t.largest


def block_grid(shape: Sequence[int], block: Sequence[int] | None) -> tuple[int, ...]:
    """Blocks along each axis; the last one of an axis may be partial."""
    if block is None:
        return (1,) * len(shape)
    if len(block) != len(shape) or any(b < 1 for b in block):
        raise ValueError(f"block {block} of {shape}")
    return tuple(-(-n // b) for n, b in zip(shape, block, strict=True))


def _block_of(x: TensorRef, block: Sequence[int] | None) -> Column:
    """The number of each cell's block."""
    if block is None:
        return F.lit(0).cast("long")
    grid = block_grid(x.shape, block)
    return position([F.expr(f"i{k} div {b}L") for k, b in enumerate(block)], grid)


#: A parameter tensor of so many elements at most is sent to all tasks.
SENT_ELEMENTS = 1 << 12


def _with_params(x: TensorRef, block: Sequence[int] | None, params: dict[str, TensorRef]) -> DataFrame:
    """Cells with the parameters of their block; one block for all would else be one key of one task, or a product."""
    df = x.indexed().withColumn("blk", _block_of(x, block))
    for name, p in params.items():
        own = p.cells().select(F.col("pos").alias("blk"), F.col("v").alias(name))
        df = df.join(F.broadcast(own) if size(p.shape) <= SENT_ELEMENTS else own, "blk")
    return df


def dequantize(q: TensorRef, scheme: Scheme, *, scale: TensorRef | None = None, zero: TensorRef | None = None, book: TensorRef | None = None, scale_scale: TensorRef | None = None, scale_zero: TensorRef | None = None) -> TensorRef:
    """Numbers from integers, then the clip, the output type, and the stored order."""
    match scheme.formula:
        case "sym" if zero is not None:
            raise ValueError("a symmetric scheme has no zero point")
        case "affine-sub" if zero is None:
            raise ValueError("affine-sub needs a zero point")
        case "nested" if scale_scale is None:
            raise ValueError("nested needs the scale of its scales")
    given = {"s": scale, "z": zero, "ss": scale_scale, "zs": scale_zero}
    df = _with_params(q, scheme.block, {k: p for k, p in given.items() if p is not None})
    v, one, none = F.col("v"), S.lit(1), S.lit(0)
    s = F.col("s") if scale is not None else one
    z = F.col("z") if zero is not None else none
    if scheme.formula in ("codebook", "codebook-raw"):
        if book is None:
            raise ValueError("a codebook scheme needs its book")
        looked = gather(book, q, 0)
        df = df.drop("v").join(looked.cells(), "pos")
        value = v * s if scheme.formula == "codebook" else v
    else:
        zs = F.col("zs") if scale_zero is not None else none
        value = {"affine-sub": (v - z) * s, "affine-add": v * s + z, "sym": v * s, "nested": (v - z) * ((s - zs) * (F.col("ss") if scale_scale is not None else one))}[scheme.formula]
    if scheme.clip:
        value = F.least(F.greatest(value, S.lit(scheme.clip[0])), S.lit(scheme.clip[1]))
    to = dtype(scheme.out)
    out = q.with_cells(df.select("pos", round_through(value, to).alias("v")), to=to)
    if scheme.order:
        from ..tensor import literal

        out = gather(out, literal(q.spark, list(scheme.order)), 0)
    return out


def block_params(x: TensorRef, scheme: Scheme) -> DataFrame:
    """(blk, s, z) of each block: the scale that fits its values, and the zero point."""
    low, high = scheme.range
    df = x.indexed().withColumn("blk", _block_of(x, scheme.block))
    v = F.col("v")
    if scheme.formula == "sym":
        top = F.max(F.abs(v))
        return df.groupBy("blk").agg(F.when(top == 0, S.lit(1)).otherwise(top / high).alias("s")).withColumn("z", S.lit(0))
    if scheme.formula == "affine-sub":
        got = df.groupBy("blk").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
        s = F.when(F.col("hi") == F.col("lo"), S.lit(1)).otherwise((F.col("hi") - F.col("lo")) / (high - low))
        return got.withColumn("s", s).withColumn("z", F.rint(S.lit(low) - F.col("lo") / F.col("s"))).select("blk", "s", "z")
    if scheme.formula == "affine-add":
        got = df.groupBy("blk").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
        s = F.when(F.col("hi") == F.col("lo"), S.lit(1)).otherwise((F.col("hi") - F.col("lo")) / (high - low))
        return got.withColumn("s", s).withColumn("z", F.col("lo") - S.lit(low) * F.col("s")).select("blk", "s", "z")
    raise ValueError(f"{scheme.formula} derives no parameters")


def quantize(x: TensorRef, scheme: Scheme, *, scale: TensorRef | None = None, zero: TensorRef | None = None, book: TensorRef | None = None) -> tuple[TensorRef, TensorRef, TensorRef]:
    """Integers, scales and zero points; parameters are derived per block where not given."""
    if scheme.formula in ("codebook", "codebook-raw"):
        if book is None:
            raise ValueError("a codebook scheme needs its book")
        return codebook_nearest(x, book), scale or book, zero or book
    grid = block_grid(x.shape, scheme.block)
    if scale is None:
        params = block_params(x, scheme)
        scale = x.with_cells(params.select(F.col("blk").alias("pos"), F.col("s").alias("v")), grid)
        zero = x.with_cells(params.select(F.col("blk").alias("pos"), F.col("z").alias("v")), grid)
        df = x.indexed().withColumn("blk", _block_of(x, scheme.block)).join(params, "blk")
    else:
        df = _with_params(x, scheme.block, {"s": scale, **({"z": zero} if zero is not None else {})})
        if zero is None:
            df = df.withColumn("z", S.lit(0))
            zero = scale.map(lambda _: S.lit(0))
    v, s, z = F.col("v"), F.col("s"), F.col("z")
    raw = S.fdiv(v - z, s) if scheme.formula == "affine-add" else S.fdiv(v, s) + (z if scheme.formula == "affine-sub" else 0)
    low, high = scheme.range
    q = F.least(F.greatest(F.rint(raw), S.lit(low)), S.lit(high))
    return x.with_cells(df.select("pos", q.alias("v")), to=dtype(scheme.q)), scale, zero


def fake_quant(x: TensorRef, scheme: Scheme, scale: TensorRef | None = None, zero: TensorRef | None = None) -> TensorRef:
    """Quantize and dequantize within one projection over the block's parameters, derived where not given."""
    low, high = scheme.range
    if scale is None:
        df = x.indexed().withColumn("blk", _block_of(x, scheme.block)).join(block_params(x, scheme), "blk")
    else:
        df = _with_params(x, scheme.block, {"s": scale, **({"z": zero} if zero is not None else {})})
        df = df if zero is not None else df.withColumn("z", S.lit(0))
    v, s, z = F.col("v"), F.col("s"), F.col("z")
    clip = lambda q: F.least(F.greatest(F.rint(q), S.lit(low)), S.lit(high))
    out = {"sym": lambda: clip(S.fdiv(v, s)) * s, "affine-sub": lambda: (clip(S.fdiv(v, s) + z) - z) * s, "affine-add": lambda: clip(S.fdiv(v - z, s)) * s + z}[scheme.formula]()
    return x.with_cells(df.select("pos", out.alias("v")))


def qmatmul(q: TensorRef, b: TensorRef, scheme: Scheme, *, scale: TensorRef | None = None, zero: TensorRef | None = None) -> TensorRef:
    """Dequantize q, then multiply by b."""
    from .contract import matmul

    return matmul(dequantize(q, scheme, scale=scale, zero=zero), b)


def normal_float(bits: int) -> list[float]:
    """Quantiles of the normal distribution, one of them zero, scaled to -1 .. 1."""
    n, d = 1 << bits, statistics.NormalDist()
    edge = 0.5 * ((1 - 1 / (2 * n)) + (1 - 1 / (2 * (n - 1))))
    upper = [d.inv_cdf(edge + (0.5 - edge) * k / (n // 2)) for k in range(n // 2)]
    lower = [-d.inv_cdf(edge + (0.5 - edge) * k / (n // 2 - 1)) for k in range(n // 2 - 1)]
    book = sorted([*lower, 0.0, *upper])
    top = max(abs(book[0]), abs(book[-1]))
    return [x / top for x in book]


def codebook_nearest(x: TensorRef, book: TensorRef) -> TensorRef:
    """The index of the nearest entry, the smaller one on a tie.

    The book is a row of its own: an array that each cell searches, so cells
    are not multiplied by entries.
    """
    entries = book.cells().agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("book"))
    df = x.cells().crossJoin(F.broadcast(entries))  # one row with one array
    far = F.struct(S.lit(S.INF).alias("d"), F.lit(-1).cast("long").alias("k"))
    best = F.aggregate("book", far, lambda acc, e: F.when(F.abs(e["v"] - F.col("v")) < acc["d"], F.struct(F.abs(e["v"] - F.col("v")).alias("d"), e["pos"].alias("k"))).otherwise(acc))
    return x.with_cells(df.select("pos", best["k"].cast("double").alias("v")), to=dtype("i32"))


#: Parts of a block's range that requantization tries (fixed values).
CLIP_RATIOS = (1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5)


def requantize(x: TensorRef, bits: int, group: int, *, kind: str = "sym", activation: TensorRef | None = None, store: str | DType = "f32") -> DataFrame:
    """Per group the clip ratio of least weighted squared error: blk, ratio, s, z, cost, clipped.

    The scale is rounded to the type that it is stored as before errors are
    measured; of equal costs the first ratio wins.
    """
    if not 2 <= bits <= 8 or kind not in ("sym", "affine"):
        raise ValueError(f"{kind}:{bits}:{group}")
    if x.shape[-1] % group:
        raise ValueError(f"groups of {group} in {x.shape[-1]}")
    low, high = (-(1 << (bits - 1)) + 1, (1 << (bits - 1)) - 1) if kind == "sym" else (0, (1 << bits) - 1)
    df = x.cells().withColumn("blk", F.expr(f"pos div {group}L"))
    if activation is not None:
        act = activation.cells().select(F.col("pos").alias("c"), F.col("v").alias("act"))
        df = df.withColumn("c", F.col("pos") % x.shape[-1]).join(act, "c")
    else:
        df = df.withColumn("act", S.lit(1))
    v = F.col("v")
    whole = df.groupBy("blk").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    tried = F.posexplode(F.array(*(S.lit(r) for r in CLIP_RATIOS)))
    tries = whole.select("blk", "lo", "hi", tried.alias("turn", "ratio"))
    if kind == "sym":
        s = F.greatest(F.abs("lo"), F.abs("hi")) * F.col("ratio") / high
        tries = tries.withColumn("s", round_through(F.when(s == 0, S.lit(1)).otherwise(s), store)).withColumn("z", S.lit(0))
    else:
        s = (F.col("hi") - F.col("lo")) * F.col("ratio") / high
        tries = tries.withColumn("s", round_through(F.when(s == 0, S.lit(1)).otherwise(s), store)).withColumn("z", F.rint(-F.col("lo") * F.col("ratio") / F.col("s")))
    raw = F.rint(v / F.col("s")) + F.col("z")
    q = F.least(F.greatest(raw, S.lit(low)), S.lit(high))
    err = (q - F.col("z")) * F.col("s") - v
    cost = df.join(tries, "blk").groupBy("blk", "turn", "ratio", "s", "z").agg(F.sum(F.col("act") * F.col("act") * err * err).alias("cost"), F.count_if(raw != q).alias("clipped"), F.max(F.abs(err)).alias("max_abs_error"))
    best = cost.groupBy("blk").agg(F.min_by(F.struct("ratio", "s", "z", "cost", "clipped", "max_abs_error"), F.struct("cost", "turn")).alias("b"))
    return best.select("blk", "b.*")


def unpack_words(words: DataFrame, bits: int, *, key: str = "pos", word: str = "w", order: Sequence[int] | None = None) -> DataFrame:
    """(pos, v) of the fields of 32-bit words, lowest first or in ``order``.

    The order of AWQ's four-bit fields is :data:`AWQ_ORDER`.
    """
    per = 32 // bits
    places = list(order or range(per))
    mask = (1 << bits) - 1
    fields = F.array(*(F.shiftrightunsigned(F.col(word).cast("long"), bits * p).bitwiseAND(F.lit(mask)).cast("double") for p in places))
    return words.select((F.col(key) * per).alias("_base"), F.posexplode(fields).alias("k", "v")).select((F.col("_base") + F.col("k")).alias("pos"), "v")


def pack_words(fields: DataFrame, bits: int, *, order: Sequence[int] | None = None) -> DataFrame:
    """(pos, w): the inverse of :func:`unpack_words`; missing fields are zero."""
    per = 32 // bits
    places = list(order or range(per))
    shift = F.element_at(F.array(*(F.lit(bits * p) for p in places)), (F.col("pos") % per + 1).cast("int"))
    field = F.expr(f"(cast(v as bigint) & {(1 << bits) - 1}L)") * F.pow(F.lit(2.0), shift).cast("long")
    return fields.groupBy(F.expr(f"pos div {per}L").alias("pos")).agg(F.sum(field).cast("long").alias("w"))


#: Places of successive fields in a packed word (fixed values).
AWQ_ORDER = (0, 4, 1, 5, 2, 6, 3, 7)


def histogram(tensors: DataFrame, *, label: str = "quantization", elements: str = "elements") -> DataFrame:
    """Tensors and elements per quantization label."""
    return tensors.groupBy(label).agg(F.count("*").alias("tensors"), F.sum(elements).alias("elements"))


def rank_in_block(x: TensorRef, block: int) -> DataFrame:
    """Each cell's rank by magnitude within its block of the last axis."""
    df = x.cells().withColumn("blk", F.expr(f"pos div {block}L"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("blk").orderBy(F.abs("v").desc(), "pos")))
