"""Integer-packed weights of GPTQ, AWQ, four-bit and eight-bit checkpoints as lazy tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dtypes import TYPES
from ..operators.elementwise import mul
from ..operators.quant import AWQ_ORDER, Scheme, dequantize, normal_float
from ..operators.structure import reshape
from ..tensor import TensorRef, from_cells, literal, size


def gptq(qweight: TensorRef, qzeros: TensorRef, scales: TensorRef, *, bits: int = 4, group: int = 128, plus_one: bool = True) -> TensorRef:
    """[in, out] weights: words pack along the input axis, zeros along the output axis.

    Version 1 stores each zero point one below its value; ``plus_one`` adds it back.
    """
    if bits not in (2, 4, 8):
        raise ValueError(f"{bits}-bit words are refused")
    per, mask = 32 // bits, (1 << bits) - 1
    rows, out = qweight.shape[0] * per, qweight.shape[1]
    fields = F.posexplode(F.array(*(F.shiftrightunsigned(F.col("v").cast("long"), bits * k).bitwiseAND(mask) for k in range(per)))).alias("k", "q")
    q = qweight.indexed().select("i0", "i1", fields)
    q = from_cells(q.select(((F.col("i0") * per + F.col("k")) * out + F.col("i1")).alias("pos"), F.col("q").alias("v")), (rows, out), "u8")
    z = qzeros.indexed().select("i0", "i1", fields)
    zero = from_cells(z.select((F.col("i0") * out + F.col("i1") * per + F.col("k")).alias("pos"), (F.col("q") + (1 if plus_one else 0)).alias("v")), (qzeros.shape[0], out))
    return dequantize(q, Scheme("affine-sub", "u8", (group, 1)), scale=scales, zero=zero)


def awq(qweight: TensorRef, qzeros: TensorRef, scales: TensorRef, *, group: int = 128) -> TensorRef:
    """[in, out] weights: eight interleaved four-bit fields along the output axis."""
    fields = F.posexplode(F.array(*(F.shiftrightunsigned(F.col("v").cast("long"), 4 * k).bitwiseAND(15) for k in AWQ_ORDER))).alias("k", "q")

    def unpacked(t: TensorRef, to: str) -> TensorRef:
        out = t.shape[1] * 8
        df = t.indexed().select("i0", "i1", fields)
        return from_cells(df.select((F.col("i0") * out + F.col("i1") * 8 + F.col("k")).alias("pos"), F.col("q").alias("v")), (t.shape[0], out), to)

    return dequantize(unpacked(qweight, "u8"), Scheme("affine-sub", "u8", (group, 1)), scale=scales, zero=unpacked(qzeros, "f64"))


#: Values of the sixteen four-bit float codes, as twelfths of the block's largest (fixed values).
FP4 = tuple(x / 12 for x in (0, 0.0625, 8, 12, 4, 6, 2, 3, 0, -0.0625, -8, -12, -4, -6, -2, -3))


def four_bit(packed: TensorRef, absmax: TensorRef, shape: tuple[int, ...], book: TensorRef, *, block: int = 64) -> TensorRef:
    """Indices into a book of sixteen values, scaled by block.

    Blocks run over the flattened tensor, the high half of each byte first.
    """
    halves = F.posexplode(F.array(F.shiftright(F.col("v").cast("int"), 4), F.col("v").cast("int").bitwiseAND(15))).alias("k", "q")
    n = packed.shape[0] * 2
    q = from_cells(packed.cells().select("pos", halves).select((F.col("pos") * 2 + F.col("k")).alias("pos"), F.col("q").alias("v")), (n,), "u8")
    flat = dequantize(q, Scheme("codebook", "u8", (block,)), scale=absmax, book=book)
    return TensorRef(flat.df.where(F.col("pos") < size(shape)), shape, flat.v, flat.dtype)


def nf4(packed: TensorRef, absmax: TensorRef, shape: tuple[int, ...], *, block: int = 64) -> TensorRef:
    """Four-bit quantiles of the normal distribution."""
    return four_bit(packed, absmax, shape, literal(packed.spark, normal_float(4)), block=block)


def fp4(packed: TensorRef, absmax: TensorRef, shape: tuple[int, ...], *, block: int = 64) -> TensorRef:
    """Four-bit floats."""
    return four_bit(packed, absmax, shape, literal(packed.spark, list(FP4)), block=block)


def nested_scales(codes: TensorRef, book: TensorRef, absmax: TensorRef, offset: float, *, block: int = 256) -> TensorRef:
    """Block scales that are quantized themselves: book[code] * absmax + offset, by blocks of scales."""
    return dequantize(codes, Scheme("codebook", "u8", (block,)), scale=absmax, book=book).map(lambda v: v + offset)


def int8_rows(q: TensorRef, largest: TensorRef) -> TensorRef:
    """Eight-bit rows against each row's largest magnitude: q * largest / 127."""
    return mul(q.map(lambda v: v, TYPES["f64"]), reshape(largest.map(lambda v: v / 127), (-1, 1)))
