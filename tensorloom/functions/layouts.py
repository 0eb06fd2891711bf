"""Layouts: where each element of a tensor lies, as expressions of its position.

A layout turns a row-major position into a place in storage, counted in
elements, and with a type into a bit offset.  ``interleaved``, ``sharded`` and
``opaque`` layouts have no such formula and say so.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import strides
from .dtypes import DType, dtype

KINDS = ("strided", "tiled", "blocked-scaled", "packed", "interleaved", "sharded", "opaque")
ORDERS = ("row-major", "col-major")
#: Where the scales of blocks lie.
SCALES = ("scales-after", "scales-before", "scales-inline")


@dataclass(frozen=True)
class Layout:
    """``steps`` and ``offset`` are of strided, ``block`` of tiled and blocked-scaled, the rest of packed layouts."""

    kind: str = "strided"
    order: str = "row-major"
    steps: tuple[int, ...] | None = None
    offset: int = 0
    block: tuple[int, ...] = ()
    inner: str = "row-major"
    scale: str = "f16"
    scales: str = "scales-after"
    per_word: int = 1
    word_bits: int = 8
    low_first: bool = True

    def __post_init__(self):
        if self.kind not in KINDS or self.order not in ORDERS or self.inner not in ORDERS or self.scales not in SCALES:
            raise ValueError(f"no layout {self}")


def steps_of(order: str, shape: Sequence[int]) -> list[int]:
    """Element strides of a dense array."""
    return strides(shape) if order == "row-major" else list(reversed(strides(list(reversed(shape)))))


def grid(layout: Layout, shape: Sequence[int]) -> list[int]:
    return [-(-n // b) for n, b in zip(shape, layout.block, strict=True)]


def faults(layout: Layout, shape: Sequence[int], to: str | DType) -> list[str]:
    """Why a layout does not place every element of its own (R-T03); nothing if it does."""
    t, out = dtype(to), []
    if layout.kind in ("tiled", "blocked-scaled"):
        if len(layout.block) != len(shape) or any(b < 1 for b in layout.block):
            out.append(f"blocks {layout.block} of {tuple(shape)}")
    if layout.kind == "strided":
        if layout.offset < 0:
            out.append("a negative offset")
        if layout.steps is not None:
            if len(layout.steps) != len(shape):
                out.append(f"{len(layout.steps)} strides of rank {len(shape)}")
            else:
                reach = 0  # sorted by stride, each axis must step over all that lies below it
                for step, n in sorted((s, n) for s, n in zip(layout.steps, shape, strict=True) if n > 1):
                    if step <= reach:
                        out.append("elements overlap")
                        break
                    reach += step * (n - 1)
    if layout.kind == "packed" and layout.per_word * math.ceil(t.bits) > layout.word_bits:
        out.append(f"{layout.per_word} of {t.name} in {layout.word_bits} bits")
    return out


def place(layout: Layout, shape: Sequence[int], pos: Column) -> Column | None:
    """The place in storage of row-major position ``pos``, in elements; None where there is no formula."""
    index = [F.floor(pos / F.lit(s)).cast("long") % F.lit(n) for s, n in zip(strides(shape), shape, strict=True)]

    def total(columns: Sequence[Column], steps: Sequence[int]) -> Column:
        out = F.lit(0).cast("long")
        for c, s in zip(columns, steps, strict=True):
            out = out + c * F.lit(s)
        return out

    match layout.kind:
        case "strided":
            return total(index, layout.steps or steps_of(layout.order, shape)) + F.lit(layout.offset)
        case "packed":
            return total(index, steps_of(layout.order, shape))
        case "tiled" | "blocked-scaled":
            outer = [F.floor(c / F.lit(b)).cast("long") for c, b in zip(index, layout.block, strict=True)]
            inner = [c % F.lit(b) for c, b in zip(index, layout.block, strict=True)]
            tiled = layout.kind == "tiled"
            first = total(outer, steps_of(layout.order if tiled else "row-major", grid(layout, shape)))
            return first * F.lit(math.prod(layout.block)) + total(inner, steps_of(layout.inner if tiled else "row-major", layout.block))
    return None


def bit_offset(layout: Layout, shape: Sequence[int], to: str | DType, pos: Column) -> Column | None:
    """The bit at which the element of row-major position ``pos`` begins."""
    t, at = dtype(to), place(layout, shape, pos)
    if at is None:
        return None
    if layout.kind == "packed":
        word, slot, wide = F.floor(at / F.lit(layout.per_word)).cast("long"), at % F.lit(layout.per_word), math.ceil(t.bits)
        within = slot * F.lit(wide) if layout.low_first else F.lit(layout.word_bits) - (slot + 1) * F.lit(wide)
        return word * F.lit(layout.word_bits) + within
    if layout.kind == "blocked-scaled":
        n = math.prod(layout.block)
        block_bits, scale_bits = t.packed_bytes(n) * 8, dtype(layout.scale).packed_bytes(1) * 8
        block, within = F.floor(at / F.lit(n)).cast("long"), F.floor((at % F.lit(n)) * F.lit(float(t.bits))).cast("long")
        if layout.scales == "scales-inline":
            return block * F.lit(block_bits + scale_bits) + F.lit(scale_bits) + within
        before = -(-math.prod(shape) // n) * scale_bits if layout.scales == "scales-before" else 0
        return F.lit(before) + block * F.lit(block_bits) + within
    return F.floor(at * F.lit(float(t.bits))).cast("long") if t.bits != int(t.bits) else at * F.lit(int(t.bits))


def check(spark: SparkSession, tensors: dict[str, tuple[Layout, Sequence[int], str]]) -> DataFrame:
    """Findings (rule, name, status, note) of declared layouts; one without a formula is indeterminate."""
    rows = []
    for name, (layout, shape, to) in sorted(tensors.items()):
        bad = faults(layout, shape, to)
        open_ = layout.kind in ("interleaved", "sharded", "opaque")
        rows.append(("R-T03", name, "invalid" if bad else "indeterminate" if open_ else "valid", "; ".join(bad)))
    return spark.createDataFrame(rows, "rule string, name string, status string, note string")
