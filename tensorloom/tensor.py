"""A tensor as rows of (pos, v): row-major position and value.

The handle is lazy: a DataFrame with ``pos``, a value expression over its
columns, a shape and a type on the driver.  Elementwise work on handles of one
DataFrame stays one projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dtypes import DType, dtype, round_through


def strides(shape: Sequence[int]) -> list[int]:
    out = [1] * len(shape)
    for i in range(len(shape) - 2, -1, -1):
        out[i] = out[i + 1] * shape[i + 1]
    return out


def size(shape: Sequence[int]) -> int:
    return math.prod(shape)


def axis_of(axis: int, rank: int) -> int:
    if not -rank <= axis < rank:
        raise ValueError(f"axis {axis} of rank {rank}")
    return axis % rank


@dataclass(frozen=True)
class TensorRef:
    df: DataFrame
    shape: tuple[int, ...]
    v: Column
    dtype: DType

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def cells(self) -> DataFrame:
        """pos and v."""
        return self.df.select("pos", self.v.alias("v"))

    def coords(self, name: str = "pos") -> list[Column]:
        """The coordinate of each axis, from column ``name``."""
        return [F.expr(f"(`{name}` div {s}L) % {n}L") for s, n in zip(strides(self.shape), self.shape, strict=True)]

    def indexed(self, prefix: str = "i") -> DataFrame:
        """Cells with one more column per axis: i0, i1, ..."""
        return self.cells().withColumns({f"{prefix}{k}": c for k, c in enumerate(self.coords())})

    def with_cells(self, df: DataFrame, shape: Sequence[int] | None = None, to: DType | None = None) -> TensorRef:
        return TensorRef(df, tuple(shape if shape is not None else self.shape), F.col("v"), to or self.dtype)

    def map(self, f: Callable[[Column], Column], to: DType | None = None) -> TensorRef:
        """Apply a function of the value; nothing but the projection grows."""
        return replace(self, v=f(self.v), dtype=to or self.dtype)

    def rounded(self) -> TensorRef:
        """Values as the declared type stores them."""
        return self if self.dtype.name == "f64" else replace(self, v=round_through(self.v, self.dtype))


def position(columns: Sequence[Column], shape: Sequence[int]) -> Column:
    """The row-major position of coordinates."""
    out = F.lit(0).cast("long")
    for c, s in zip(columns, strides(shape), strict=True):
        out = out + c.cast("long") * s
    return out


def from_cells(df: DataFrame, shape: Sequence[int], to: str | DType = "f64", *, pos: str = "pos", v: str = "v") -> TensorRef:
    return TensorRef(df.select(F.col(pos).cast("long").alias("pos"), F.col(v).cast("double").alias("v")), tuple(shape), F.col("v"), dtype(to))


def from_arrays(df: DataFrame, row: Column, values: str, rows: int, width: int, to: str | DType = "f64") -> TensorRef:
    """A matrix from one array per row; ``row`` is the row number."""
    flat = df.select(row.cast("long").alias("r"), F.posexplode(F.col(values)).alias("c", "v"))
    return from_cells(flat.select((F.col("r") * width + F.col("c")).alias("pos"), "v"), (rows, width), to)


def generate(spark: SparkSession, shape: Sequence[int], value: Callable[[Column], Column], to: str | DType = "f64") -> TensorRef:
    """A tensor whose value is a function of the position."""
    df = spark.range(size(shape)).select(F.col("id").alias("pos"))
    return TensorRef(df, tuple(shape), value(F.col("pos")).cast("double"), dtype(to))


def full(spark: SparkSession, shape: Sequence[int], value: float, to: str | DType = "f64") -> TensorRef:
    return generate(spark, shape, lambda _: F.lit(float(value)), to)


def zeros(spark: SparkSession, shape: Sequence[int], to: str | DType = "f64") -> TensorRef:
    return full(spark, shape, 0.0, to)


def ones(spark: SparkSession, shape: Sequence[int], to: str | DType = "f64") -> TensorRef:
    return full(spark, shape, 1.0, to)


def arange(spark: SparkSession, n: int, start: float = 0.0, step: float = 1.0, to: str | DType = "f64") -> TensorRef:
    return generate(spark, (n,), lambda p: F.lit(float(start)) + F.lit(float(step)) * p, to)


def eye(spark: SparkSession, rows: int, columns: int | None = None, to: str | DType = "f64") -> TensorRef:
    wide = columns or rows
    return generate(spark, (rows, wide), lambda p: F.when(F.expr(f"pos div {wide}L") == p % wide, 1.0).otherwise(0.0), to)


def literal(spark: SparkSession, values, shape: Sequence[int] | None = None, to: str | DType = "f64") -> TensorRef:
    """A small tensor from the driver's own numbers, as a local relation: the planner knows its size."""
    import numpy as np
    import pyarrow as pa

    a = np.asarray(values, dtype=float)
    cells = pa.table({"pos": pa.array(np.arange(a.size), pa.int64()), "v": pa.array(a.ravel(), pa.float64())})
    return from_cells(spark.createDataFrame(cells), tuple(shape or a.shape), to)


def collect(t: TensorRef, limit: int = 1 << 20):
    """The values as a NumPy array; refused above ``limit`` elements."""
    import numpy as np

    if size(t.shape) > limit:
        raise ValueError(f"{size(t.shape)} elements; raise the limit to collect them")
    out = np.full(size(t.shape), np.nan)
    for r in t.cells().collect():
        out[r.pos] = r.v
    return out.reshape(t.shape)
