"""The eight sparse schemes: each gives the dense tensor that it stands for.

Parts are tensors; wrong parts are errors, never dropped cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..tensor import TensorRef, position, size

SCHEMES = ("coo", "csr", "csc", "bsr", "nm", "bitmask", "ragged", "blocklist")


def _dense(values: TensorRef, cells: DataFrame, shape: Sequence[int], fill: float) -> TensorRef:
    """All cells: those given, the rest filled."""
    grid = values.spark.range(size(shape)).select(F.col("id").alias("pos"))
    return values.with_cells(grid.join(cells.select("pos", "v"), "pos", "left").select("pos", F.coalesce("v", S.lit(fill)).alias("v")), shape)


def _inside(c: Column, n: int, what: str) -> Column:
    return F.when((c >= 0) & (c < n), c).otherwise(F.raise_error(F.concat(F.lit(f"{what} out of range: "), c.cast("string"))).cast("long"))


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def coo(indices: TensorRef, values: TensorRef, shape: Sequence[int], fill: float = 0.0) -> TensorRef:
    """indices is [rank, n]; of cells given twice the later wins."""
    n = values.shape[0]
    _need(indices.shape == (len(shape), n), f"indices {indices.shape} for {n} values of rank {len(shape)}")
    axes = [F.max(F.when(F.col("i0") == k, F.col("v"))).cast("long").alias(f"c{k}") for k in range(len(shape))]
    rows = indices.indexed().groupBy(F.col("i1").alias("k")).agg(*axes)
    own = values.cells().select(F.col("pos").alias("k"), "v")
    pos = position([_inside(F.col(f"c{k}"), extent, "index") for k, extent in enumerate(shape)], shape)
    return _dense(values, rows.join(own, "k").select(pos.alias("pos"), "k", "v").groupBy("pos").agg(F.max_by("v", "k").alias("v")), shape, fill)


def _runs(pointers: TensorRef, rows: int, n: int) -> DataFrame:
    """(row, k): the entries of each row, from pointers that must not fall."""
    _need(pointers.shape == (rows + 1,), f"{pointers.shape} pointers for {rows} rows")
    # Each pointer meets its successor by an equi-join on its place.
    low = pointers.cells().select(F.col("pos").alias("row"), F.col("v").cast("long").alias("lo"))
    high = pointers.cells().select((F.col("pos") - 1).alias("row"), F.col("v").cast("long").alias("hi"))
    both = low.join(high, "row")
    bad = F.raise_error(F.concat(F.lit("pointers fall or leave the values at row "), F.col("row").cast("string"))).cast("long")
    hi = F.when((F.col("hi") >= F.col("lo")) & (F.col("lo") >= 0) & (F.col("hi") <= n), F.col("hi")).otherwise(bad)
    return both.withColumn("hi", hi).where("hi > lo").select("row", "lo", F.explode(F.expr("sequence(lo, hi - 1)")).alias("k"))


def csr(indptr: TensorRef, indices: TensorRef, values: TensorRef, shape: Sequence[int], fill: float = 0.0, *, by_column: bool = False) -> TensorRef:
    """Compressed rows; or columns, with ``by_column``."""
    _need(len(shape) == 2, "compressed rows have rank 2")
    _need(indices.shape == values.shape, "as many indices as values")
    major, minor = (1, 0) if by_column else (0, 1)
    runs = _runs(indptr, shape[major], values.shape[0])
    at = indices.cells().select(F.col("pos").alias("k"), _inside(F.col("v").cast("long"), shape[minor], "index").alias("i"))
    own = values.cells().select(F.col("pos").alias("k"), "v")
    coords = [F.col("i"), F.col("row")] if by_column else [F.col("row"), F.col("i")]
    return _dense(values, runs.join(at, "k").join(own, "k").select(position(coords, shape).alias("pos"), "k", "v").groupBy("pos").agg(F.max_by("v", "k").alias("v")), shape, fill)


def csc(indptr: TensorRef, indices: TensorRef, values: TensorRef, shape: Sequence[int], fill: float = 0.0) -> TensorRef:
    return csr(indptr, indices, values, shape, fill, by_column=True)


def _block_cells(df: DataFrame, values: TensorRef, block: Sequence[int], shape: Sequence[int], corner: Sequence[Column]) -> DataFrame:
    """Cells of whole blocks, those beyond the shape clipped; df has k and the corner's columns."""
    inner = size(block)
    cells = values.cells().select(F.expr(f"pos div {inner}L").alias("k"), (F.col("pos") % inner).alias("o"), "v")
    met = df.join(cells, "k")
    coords, step = [], inner
    for c, b in zip(corner, block, strict=True):
        step //= b
        coords.append(c * b + F.expr(f"(o div {step}L) % {b}L"))
    met = met.withColumns({f"c{k}": c for k, c in enumerate(coords)})
    for k, n in enumerate(shape):
        met = met.where(F.col(f"c{k}") < n)
    return met.select(position([F.col(f"c{k}") for k in range(len(shape))], shape).alias("pos"), "v")


def bsr(indptr: TensorRef, indices: TensorRef, values: TensorRef, block: Sequence[int], shape: Sequence[int], fill: float = 0.0) -> TensorRef:
    """Compressed rows of blocks; values is [n, *block]."""
    _need(len(shape) == 2 and len(block) == 2, "blocks of rank 2")
    grid = [-(-n // b) for n, b in zip(shape, block, strict=True)]
    n = indices.shape[0]
    _need(size(values.shape) == n * size(block), "as many blocks as indices")
    runs = _runs(indptr, grid[0], n)
    at = indices.cells().select(F.col("pos").alias("k"), _inside(F.col("v").cast("long"), grid[1], "block index").alias("i"))
    return _dense(values, _block_cells(runs.join(at, "k"), values, block, shape, [F.col("row"), F.col("i")]), shape, fill)


def bitmask(mask: TensorRef, values: TensorRef, shape: Sequence[int], fill: float = 0.0, *, n: int | None = None, m: int | None = None) -> TensorRef:
    """Values in the order of the mask's set cells; as n:m, at most n in m."""
    _need(size(mask.shape) == size(shape), "a mask cell for each cell")
    chunk = 1 << 16
    on = mask.cells().where("v <> 0").withColumn("part", F.expr(f"pos div {chunk}L"))
    # Rank of set cells: within a chunk by a window, before it by the chunks' sums.
    sums = on.groupBy("part").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    k = F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1
    ranked = on.withColumn("k", k).join(before, "part").select("pos", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"))
    if m:
        _need(shape[-1] % m == 0, f"groups of {m} in {shape[-1]}")
        count = F.count("*").over(Window.partitionBy(F.expr(f"pos div {m}L")))
        ranked = ranked.withColumn("k", F.when(count <= n, F.col("k")).otherwise(F.raise_error(F.lit(f"more than {n} of {m}")).cast("long")))
    own = values.cells().select(F.col("pos").alias("k"), "v")
    both = ranked.join(own, "k", "full")
    pos = F.when(F.col("pos").isNotNull() & F.col("v").isNotNull(), F.col("pos")).otherwise(F.raise_error(F.lit("mask and values do not count the same")).cast("long"))
    return _dense(values, both.select(pos.alias("pos"), "v"), shape, fill)


def nm(mask: TensorRef, values: TensorRef, shape: Sequence[int], n: int, m: int, fill: float = 0.0) -> TensorRef:
    return bitmask(mask, values, shape, fill, n=n, m=m)


def ragged(offsets: TensorRef, values: TensorRef, shape: Sequence[int], fill: float = 0.0) -> TensorRef:
    """Rows of their own lengths, left-aligned."""
    _need(len(shape) == 2, "ragged rows have rank 2")
    runs = _runs(offsets, shape[0], values.shape[0])
    own = values.cells().select(F.col("pos").alias("k"), "v")
    at = _inside(F.col("k") - F.col("lo"), shape[1], "row length")
    return _dense(values, runs.join(own, "k").select(position([F.col("row"), at], shape).alias("pos"), "v"), shape, fill)


def blocklist(index: TensorRef, values: TensorRef, block: Sequence[int], shape: Sequence[int], fill: float = 0.0) -> TensorRef:
    """Listed blocks: index is [n] block numbers of the grid, values [n, *block]."""
    grid = [-(-n // b) for n, b in zip(shape, block, strict=True)]
    n = index.shape[0]
    _need(size(values.shape) == n * size(block), "as many blocks as indices")
    at = index.cells().select(F.col("pos").alias("k"), _inside(F.col("v").cast("long"), size(grid), "block").alias("g"))
    corner, step = [], size(grid)
    for g in grid:
        step //= g
        corner.append(F.expr(f"(g div {step}L) % {g}L"))
    return _dense(values, _block_cells(at, values, block, shape, corner), shape, fill)
