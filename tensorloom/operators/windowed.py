"""Operators along one axis that need its order: softmax, sums, sorting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..functions.dtypes import dtype
from ..tensor import TensorRef, axis_of, position, strides


def _lanes(x: TensorRef, axis: int):
    """Cells with ``lane`` (the other axes) and ``at`` (the place on the axis)."""
    axis = axis_of(axis, x.rank)
    s, n = strides(x.shape)[axis], x.shape[axis]
    df = x.cells().withColumn("at", F.expr(f"(pos div {s}L) % {n}L"))
    return df.withColumn("lane", F.col("pos") - F.col("at") * s), s


def softmax(x: TensorRef, axis: int = -1) -> TensorRef:
    df, _ = _lanes(x, axis)
    lane = Window.partitionBy("lane")
    df = df.withColumn("e", F.exp(F.col("v") - F.max("v").over(lane)))
    return x.with_cells(df.select("pos", (F.col("e") / F.sum("e").over(lane)).alias("v"))).rounded()


def cumsum(x: TensorRef, axis: int = -1) -> TensorRef:
    df, _ = _lanes(x, axis)
    run = Window.partitionBy("lane").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return x.with_cells(df.select("pos", F.sum("v").over(run).alias("v"))).rounded()


def _ranked(x: TensorRef, axis: int, descending: bool):
    """Cells with their rank on the axis; ties by place, NaN last when ascending."""
    df, s = _lanes(x, axis)
    key = F.col("v").desc() if descending else F.col("v").asc()
    return df.withColumn("rank", (F.row_number().over(Window.partitionBy("lane").orderBy(key, "at")) - 1).cast("long")), s


def sort(x: TensorRef, axis: int = -1, descending: bool = False) -> TensorRef:
    df, s = _ranked(x, axis, descending)
    return x.with_cells(df.select((F.col("lane") + F.col("rank") * s).alias("pos"), "v"))


def topk(x: TensorRef, k: int, axis: int = -1) -> tuple[TensorRef, TensorRef]:
    """The k largest values along an axis and their places, ties by place."""
    axis = axis_of(axis, x.rank)
    if not 0 < k <= x.shape[axis]:
        raise ValueError(f"the {k} largest of {x.shape[axis]}")
    df, _ = _ranked(x, axis, True)
    shape = (*x.shape[:axis], k, *x.shape[axis + 1 :])
    coords = x.coords()
    coords[axis] = F.col("rank")
    df = df.where(F.col("rank") < k).withColumn("out", position(coords, shape))
    values = x.with_cells(df.select(F.col("out").alias("pos"), "v"), shape)
    return values, x.with_cells(df.select(F.col("out").alias("pos"), F.col("at").cast("double").alias("v")), shape, dtype("i32"))


def layer_norm(x: TensorRef, weight: TensorRef | None = None, bias: TensorRef | None = None, *, kind: str = "layer", eps: float = 1e-5, axis: int = -1) -> TensorRef:
    """Root-mean-square or layer normalisation (population variance)."""
    from .elementwise import combine

    if kind not in ("rms", "layer"):
        raise ValueError(f"no norm {kind!r}")
    df, _ = _lanes(x, axis)
    lane = Window.partitionBy("lane")
    v = F.col("v")
    if kind == "rms":
        out = v / F.sqrt(F.avg(v * v).over(lane) + eps)
    else:
        out = (v - F.avg(v).over(lane)) / F.sqrt(F.var_pop(v).over(lane) + eps)
    y = x.with_cells(df.select("pos", out.alias("v")))
    if weight is not None:
        y = combine(lambda a, b: a * b, y, weight, to=x.dtype)
    if bias is not None:
        y = combine(lambda a, b: a + b, y, bias, to=x.dtype)
    return y.rounded()


#: Cells of an axis that one task folds; longer axes are folded in two steps.
SCAN_CELLS = 1 << 20


def _folded(rows: DataFrame, factor: str) -> DataFrame:
    """h = factor * h + v down each (lane, chunk), in order of k; rows stream through their partition."""

    def fold(batches):
        now, state = None, 0.0
        for batch in batches:
            lane, chunk, _, at, f, v = (batch.column(k) for k in range(6))
            out = []
            for key, x, y in zip(zip(lane.to_pylist(), chunk.to_pylist(), strict=True), f.to_pylist(), v.to_pylist(), strict=True):
                state = state * x + y if key == now else y
                now = key
                out.append(state)
            yield pa.RecordBatch.from_arrays([lane, chunk, at, pa.array(out, pa.float64())], ["lane", "chunk", "at", "h"])

    dealt = rows.select("lane", "chunk", "k", "at", F.col(factor).alias("f"), "v").repartition("lane", "chunk").sortWithinPartitions("lane", "chunk", "k")
    return dealt.mapInArrow(fold, "lane long, chunk long, at long, h double")


def scan_sum(x: TensorRef, decay: float, axis: int = -1, reverse: bool = False) -> TensorRef:
    """h_t = decay * h_(t-1) + x_t along an axis, as an ordered fold per lane.

    An axis of more than ``SCAN_CELLS`` cells is cut into chunks: each is folded
    from zero, the chunks' last values are folded by themselves, and what comes
    in from earlier chunks is added with its decay.
    """
    df, s = _lanes(x, axis)
    n = x.shape[axis_of(axis, x.rank)]
    step = F.lit(n - 1) - F.col("at") if reverse else F.col("at")
    rows = df.select("lane", "at", "v", step.cast("long").alias("k"), S.lit(decay).alias("f")).withColumn("chunk", F.expr(f"k div {SCAN_CELLS}L"))
    own = _folded(rows, "f")
    if n > SCAN_CELLS:
        place = F.lit(n - 1) - F.col("at") if reverse else F.col("at")
        ends = own.groupBy("lane", "chunk").agg(F.max_by("h", place).alias("v"), (F.max(place) - F.col("chunk") * SCAN_CELLS + 1).alias("n"))
        ends = ends.select("lane", (F.col("chunk") + 1).alias("k"), (F.col("chunk") + 1).alias("at"), "v", F.pow(S.lit(decay), F.col("n")).alias("f"), F.lit(0).cast("long").alias("chunk"))
        carried = _folded(ends, "f").select("lane", F.col("at").alias("chunk"), F.col("h").alias("carry"))
        within = place - F.col("chunk") * SCAN_CELLS + 1
        own = own.join(carried, ["lane", "chunk"], "left").select("lane", "at", (F.col("h") + F.coalesce(F.col("carry") * F.pow(S.lit(decay), within), S.lit(0))).alias("h"))
    return x.with_cells(own.select((F.col("lane") + F.col("at") * s).alias("pos"), F.col("h").alias("v")))
