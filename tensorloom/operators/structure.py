"""Structural operators: they move cells and leave values alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..tensor import TensorRef, axis_of, position, size, strides

PAD_MODES = ("constant", "edge", "reflect", "wrap")


def reshape(x: TensorRef, shape: Sequence[int]) -> TensorRef:
    """The same order under another shape; one -1 is inferred."""
    shape = list(shape)
    if shape.count(-1) > 1:
        raise ValueError("more than one extent to infer")
    if -1 in shape:
        rest = size([n for n in shape if n != -1])
        if not rest or size(x.shape) % rest:
            raise ValueError(f"cannot reshape {x.shape} to {shape}")
        shape[shape.index(-1)] = size(x.shape) // rest
    if size(shape) != size(x.shape):
        raise ValueError(f"cannot reshape {x.shape} to {shape}")
    return TensorRef(x.df, tuple(shape), x.v, x.dtype)


def permute(x: TensorRef, perm: Sequence[int]) -> TensorRef:
    """Axis k of the result is axis perm[k] of x."""
    if sorted(perm) != list(range(x.rank)):
        raise ValueError(f"{perm} is no permutation of rank {x.rank}")
    shape = tuple(x.shape[p] for p in perm)
    coords = x.coords()
    return x.with_cells(x.cells().select(position([coords[p] for p in perm], shape).alias("pos"), "v"), shape)


def transpose(x: TensorRef) -> TensorRef:
    """Swap the last two axes."""
    if x.rank < 2:
        raise ValueError("transpose needs two axes")
    return permute(x, [*range(x.rank - 2), x.rank - 1, x.rank - 2])


def squeeze(x: TensorRef, axes: Sequence[int]) -> TensorRef:
    drop = {axis_of(a, x.rank) for a in axes}
    if any(x.shape[a] != 1 for a in drop):
        raise ValueError(f"axes {sorted(drop)} of {x.shape} are not all 1")
    return reshape(x, [n for k, n in enumerate(x.shape) if k not in drop])


def broadcast_to(x: TensorRef, shape: Sequence[int]) -> TensorRef:
    """Repeat cells along axes of extent one."""
    shape = tuple(shape)
    pad = (1,) * (len(shape) - x.rank) + x.shape
    if len(pad) != len(shape) or any(a not in (1, b) for a, b in zip(pad, shape, strict=True)):
        raise ValueError(f"{x.shape} does not broadcast to {shape}")
    if pad == shape:
        return reshape(x, shape)
    step = strides(shape)
    own = TensorRef(x.df, pad, x.v, x.dtype)
    df = own.cells().withColumn("pos", position(own.coords(), shape))
    for a, b, s in zip(pad, shape, step, strict=True):
        if a != b:
            copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long"))).alias("copy")
            df = df.select("pos", "v", copies).select((F.col("pos") + F.col("copy") * s).alias("pos"), "v") if b else df.where("false")
    return x.with_cells(df.select("pos", "v"), shape)


expand = broadcast_to


def slice_(x: TensorRef, start: Sequence[int], stop: Sequence[int], step: Sequence[int] | None = None) -> TensorRef:
    """start:stop:step on every axis; out of range is an error."""
    step = list(step or [1] * x.rank)
    shape, keep, coords = [], F.lit(True), []
    for k, (a, b, s, n) in enumerate(zip(start, stop, step, x.shape, strict=True)):
        if s < 1 or not 0 <= a <= b <= n:
            raise ValueError(f"slice {a}:{b}:{s} of extent {n}")
        c = F.col(f"i{k}")
        shape.append(-(-(b - a) // s))
        if (a, b, s) != (0, n, 1):
            keep = keep & (c >= a) & (c < b) & ((c - a) % s == 0)
        coords.append(c if s == 1 and a == 0 else F.expr(f"(i{k} - {a}L) div {s}L"))
    df = x.indexed().where(keep).select(position(coords, shape).alias("pos"), "v")
    return x.with_cells(df, shape)


def concat(xs: Sequence[TensorRef], axis: int) -> TensorRef:
    axis = axis_of(axis, xs[0].rank)
    first = xs[0]
    if any(x.rank != first.rank or x.dtype != first.dtype or any(a != b for k, (a, b) in enumerate(zip(x.shape, first.shape, strict=True)) if k != axis) for x in xs):
        raise ValueError("concat needs equal types and equal other extents")
    shape = list(first.shape)
    shape[axis] = sum(x.shape[axis] for x in xs)
    out, offset = None, 0
    for x in xs:
        coords = x.coords()
        coords[axis] = coords[axis] + offset
        part = x.cells().select(position(coords, shape).alias("pos"), "v")
        out = part if out is None else out.unionByName(part)
        offset += x.shape[axis]
    return first.with_cells(out, shape)


def split(x: TensorRef, axis: int, sizes: Sequence[int], pick: int) -> TensorRef:
    axis = axis_of(axis, x.rank)
    if sum(sizes) != x.shape[axis]:
        raise ValueError(f"pieces {list(sizes)} of extent {x.shape[axis]}")
    start, stop = [0] * x.rank, list(x.shape)
    start[axis] = sum(sizes[:pick])
    stop[axis] = start[axis] + sizes[pick]
    return slice_(x, start, stop)


def _pad_source(c: Column, low: int, n: int, mode: str) -> Column:
    """The source coordinate of a padded one; outside for constant padding."""
    at = c - low
    match mode:
        case "constant":
            return at
        case "edge":
            return F.greatest(F.lit(0), F.least(at, F.lit(n - 1)))
        case "wrap":
            return F.pmod(at, F.lit(n))
        case _:  # reflect without repeating the edge
            if n == 1:
                return at * 0
            turn = F.pmod(at, F.lit(2 * (n - 1)))
            return F.least(turn, F.lit(2 * (n - 1)) - turn)


def pad(x: TensorRef, low: Sequence[int], high: Sequence[int], mode: str = "constant", value: float = 0.0) -> TensorRef:
    if mode not in PAD_MODES:
        raise ValueError(f"no padding {mode!r}")
    if mode == "reflect" and any(max(a, b) >= n for a, b, n in zip(low, high, x.shape, strict=True) if a or b):
        raise ValueError("reflect padding must be smaller than the axis")
    shape = tuple(a + n + b for a, n, b in zip(low, x.shape, high, strict=True))
    if mode == "constant":
        grid = x.spark.range(size(shape)).select(F.col("id").alias("pos"))
        inner = [c + a for c, a in zip(x.coords(), low, strict=True)]
        own = x.cells().select(position(inner, shape).alias("pos"), "v")
        return x.with_cells(grid.join(own, "pos", "left").select("pos", F.coalesce("v", S.lit(value)).alias("v")), shape)
    grid = x.spark.range(size(shape)).select(F.col("id").alias("out"))
    coords = [F.expr(f"(`out` div {s}L) % {n}L") for s, n in zip(strides(shape), shape, strict=True)]
    source = position([_pad_source(c, a, n, mode) for c, a, n in zip(coords, low, x.shape, strict=True)], x.shape)
    return x.with_cells(grid.withColumn("pos", source).join(x.cells(), "pos").select(F.col("out").alias("pos"), "v"), shape)


def _checked(index: TensorRef, extent: int) -> Column:
    """The index, or an error where it lies outside."""
    v = index.v.cast("long")
    return F.when((v >= 0) & (v < extent), v).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), v.cast("string"))).cast("long"))


def gather(x: TensorRef, index: TensorRef, axis: int = 0) -> TensorRef:
    """The index's shape takes the place of ``axis``; out of range is an error."""
    axis = axis_of(axis, x.rank)
    shape = (*x.shape[:axis], *index.shape, *x.shape[axis + 1 :])
    inner, outer = size(x.shape[axis + 1 :]), size(index.shape)
    own = index.df.select(F.col("pos").alias("at"), _checked(index, x.shape[axis]).alias("key"))
    cells = x.cells().select(F.expr(f"pos div {inner * x.shape[axis]}L").alias("before"), F.expr(f"(pos div {inner}L) % {x.shape[axis]}L").alias("key"), (F.col("pos") % inner).alias("after"), "v")
    pos = (F.col("before") * outer + F.col("at")) * inner + F.col("after")
    return x.with_cells(cells.join(own, "key").select(pos.alias("pos"), "v"), shape)


def embedding(table: TensorRef, ids: TensorRef) -> TensorRef:
    """Rows of a table by id."""
    return gather(table, ids, 0)


def scatter(x: TensorRef, index: TensorRef, updates: TensorRef, axis: int = 0, reduction: str = "replace") -> TensorRef:
    """Write updates at index along axis: replace (the last wins), add, mul, max or min."""
    if index.shape != updates.shape or index.rank != x.rank:
        raise ValueError("index and updates need the same shape and x's rank")
    axis = axis_of(axis, x.rank)
    coords = [F.expr(f"(pos div {s}L) % {n}L") for s, n in zip(strides(updates.shape), updates.shape, strict=True)]
    coords[axis] = F.col("key")
    moved = updates.cells().join(index.df.select("pos", _checked(index, x.shape[axis]).alias("key")), "pos")
    moved = moved.select(position(coords, x.shape).alias("dst"), (F.col("pos") + 1).alias("turn"), "v")
    every = x.cells().select(F.col("pos").alias("dst"), F.lit(0).cast("long").alias("turn"), "v").unionByName(moved)
    value = {
        "replace": F.max_by("v", "turn"),
        "add": F.sum("v"),
        "mul": F.product("v"),
        "max": S.max_agg(F.col("v")),
        "min": S.min_agg(F.col("v")),
    }.get(reduction)
    if value is None:
        raise ValueError(f"no reduction {reduction!r}")
    return x.with_cells(every.groupBy("dst").agg(value.alias("v")).select(F.col("dst").alias("pos"), "v"))


def relayout(x: TensorRef, layout: str) -> TensorRef:
    """A layout orders bytes, not values."""
    return x


def flat_slice(x: TensorRef, offset: int, shape: Sequence[int]) -> TensorRef:
    """A parameter out of one flat buffer."""
    n = size(shape)
    if x.rank != 1 or offset < 0 or offset + n > x.shape[0]:
        raise ValueError(f"{n} elements at {offset} of {x.shape}")
    return reshape(slice_(x, [offset], [offset + n]), shape)
