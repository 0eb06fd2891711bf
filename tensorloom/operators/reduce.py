"""Reductions, norms and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..tensor import TensorRef, axis_of, position, size

KINDS = ("sum", "mean", "prod", "max", "min", "any", "all")


def _aggregate(kind: str, order: str = "unspecified") -> Column:
    v = F.col("v")
    if kind == "sum" and order != "unspecified":
        values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
        return {"sequential": S.ordered_sum, "kahan": S.kahan_sum, "pairwise": S.pairwise_sum}[order](values)
    return {
        "sum": F.sum(v),
        "mean": F.avg(v),
        "prod": F.product(v),
        "max": S.max_agg(v),
        "min": S.min_agg(v),
        "any": F.bool_or(v != 0).cast("double"),
        "all": F.bool_and(v != 0).cast("double"),
    }[kind]


#: Values of a reduction over nothing.
EMPTY = {"sum": 0.0, "mean": S.NAN, "prod": 1.0, "max": -S.INF, "min": S.INF, "any": 0.0, "all": 1.0}


def reduce(x: TensorRef, kind: str, axes: Sequence[int] | None = None, keepdims: bool = False, order: str = "unspecified") -> TensorRef:
    """Reduce over axes (all where none is named).

    ``order`` pins a sum's order: sequential, kahan and pairwise gather each group's
    values, so ask for them only where groups are small.
    """
    if kind not in KINDS:
        raise ValueError(f"no reduction {kind!r}")
    gone = {axis_of(a, x.rank) for a in (axes if axes is not None else range(x.rank))}
    kept = [k for k in range(x.rank) if k not in gone]
    shape = tuple(x.shape[k] for k in kept)
    final = tuple(1 if k in gone else n for k, n in enumerate(x.shape)) if keepdims else shape
    coords = x.coords()
    out = position([coords[k] for k in kept], shape) if kept else F.lit(0).cast("long")
    if size(x.shape) == 0 and size(shape):
        return x.with_cells(x.spark.range(size(shape)).select(F.col("id").alias("pos"), S.lit(EMPTY[kind]).alias("v")), final)
    got = x.cells().withColumn("out", out).groupBy("out").agg(_aggregate(kind, order).alias("v"))
    return x.with_cells(got.select(F.col("out").alias("pos"), "v"), final).rounded()


def norm(x: TensorRef, axis: int, p: float = 2) -> TensorRef:
    """p-norm along an axis, which stays with extent one; p may be infinity."""
    axis = axis_of(axis, x.rank)
    if p == 1:
        return reduce(x.map(F.abs), "sum", [axis], True)
    if p == 2:
        return reduce(x.map(lambda v: v * v), "sum", [axis], True).map(F.sqrt).rounded()
    if p == S.INF:
        return reduce(x.map(F.abs), "max", [axis], True)
    return reduce(x.map(lambda v: F.pow(F.abs(v), F.lit(p))), "sum", [axis], True).map(lambda v: F.pow(v, F.lit(1 / p))).rounded()


def stats(df: DataFrame, by: Sequence[str] = (), v: str = "v") -> DataFrame:
    """Per group: minimum, maximum, mean and largest magnitude of finite values, and counts.

    Without a finite value the first three are null and absmax is zero.
    """
    x = F.col(v)
    ok = F.when(S.finite(x), x)
    aggs = [
        F.min(ok).alias("min"),
        F.max(ok).alias("max"),
        F.avg(ok).alias("mean"),
        F.coalesce(F.max(F.abs(ok)), S.lit(0)).alias("absmax"),
        F.count_if(F.isnan(x)).alias("nan"),
        F.count_if(F.abs(x) == S.lit(S.INF)).alias("inf"),
        F.count_if(x != 0).alias("nonzero"),
        F.count("*").alias("n"),
    ]
    return df.groupBy(*by).agg(*aggs)


def stats_check(declared: DataFrame, measured: DataFrame, key: str = "tensor", within: float = 1e-9) -> DataFrame:
    """Declared against measured statistics: (key, field, status), three-valued."""
    fields = ("min", "max", "mean", "absmax", "nan", "inf", "nonzero")
    both = declared.select(key, *(F.col(f).cast("double").alias(f"d_{f}") for f in fields)).join(measured.select(key, *(F.col(f).cast("double").alias(f"m_{f}") for f in fields)), key, "left")
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"d_{f}").alias("d"), F.col(f"m_{f}").alias("m")) for f in fields))).alias("r")
    same = F.abs(F.col("r.d") - F.col("r.m")) <= within * F.greatest(F.lit(1.0), F.abs(F.col("r.m")))
    status = F.when(F.col("r.d").isNull(), "absent").when(F.col("r.m").isNull(), "indeterminate").when(same, "valid").otherwise("invalid")
    return both.select(key, rows).select(key, F.col("r.field").alias("field"), status.alias("status"))


def effective_bits(df: DataFrame, stored: str, elements: str) -> Column:
    """Stored bits per parameter over all rows."""
    return F.sum(F.col(stored)) * 8 / F.sum(F.col(elements))
