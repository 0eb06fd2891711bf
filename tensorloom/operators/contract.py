"""Contractions: matrix products and einsum, by tiles or as joins with aggregation.

Two operands that share summed letters are one batched matrix product.  Large
ones are cut into tiles of bounded size; groups of tiles meet in a task, are
multiplied by NumPy, and partial sums over the depth are added up afterwards.
Small ones, and sums with a pinned order, are joined cell by cell.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..functions.dtypes import wider
from ..functions.rows import runs
from ..tensor import TensorRef, position, size, strides
from .elementwise import broadcast_shape
from .structure import broadcast_to, reshape

ORDERS = ("unspecified", "sequential", "kahan", "pairwise")
#: Extents of a tile at most: rows, and what is summed over.
TILE_ROWS, TILE_DEPTH = 256, 1024
#: Products of so many terms or more are made by tiles.
TILED_TERMS = 1 << 16
#: Groups of tiles along each side that meet in tasks; more only where a group would pass the bytes that a task holds.
GROUPS, HELD_BYTES = 8, 32 << 20
#: Groups that get a partition each; more are dealt by a hash.
OWN_PARTITIONS = 256
#: Values that are given out at once.
OUT_VALUES = 1 << 18


def tiled(cells: DataFrame, row: Column, depth: Column, v: str, keys: list[str], rows: int, depths: int, *, key: str = "long") -> DataFrame:
    """``keys`` (of type ``key``), tile row ``ti``, tile depth ``tk``, and the tile's cells as bytes, which :func:`dense` reads.

    Cells stream through their partition, which holds one tile.
    """
    df = cells.select(*(F.col(k).cast(key).alias(k) for k in keys), row.cast("long").alias("_r"), depth.cast("long").alias("_d"), F.col(v).cast("double").alias("v"))
    at = ((F.col("_r") % rows) * depths + F.col("_d") % depths).cast("int").alias("at")
    df = df.select(*keys, F.expr(f"_r div {rows}L").cast("int").alias("ti"), F.expr(f"_d div {depths}L").cast("int").alias("tk"), at, "v")
    names = [*keys, "ti", "tk"]
    types = [*([pa.int64() if key == "long" else pa.string()] * len(keys)), pa.int32(), pa.int32()]

    def pack(batches):
        for at, (where, what) in runs(batches, len(names)):
            if 12 * len(where) < 8 * rows * depths:  # few cells
                raw = struct.pack("<q", len(where)) + where.astype("<i4").tobytes() + what.astype("<f8").tobytes()
            else:
                full = np.zeros(rows * depths)
                full[where] = what
                raw = struct.pack("<q", -1) + full.tobytes()
            yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(at, types, strict=True)), pa.array([raw], pa.binary())], [*names, "cells"])

    schema = ", ".join([*(f"{k} {key}" for k in keys), "ti int", "tk int", "cells binary"])
    return df.repartition(*names).sortWithinPartitions(*names).mapInArrow(pack, schema)


def dense(raw, rows: int, depths: int, wide: int) -> np.ndarray:
    """A tile's cells as a matrix; ``wide`` is the depth that places were counted with."""
    n = struct.unpack_from("<q", raw)[0]
    if n < 0:
        return np.frombuffer(raw, "<f8", offset=8).reshape(-1, wide)[:rows, :depths]
    out = np.zeros((rows, depths))
    at = np.frombuffer(raw, "<i4", n, 8)
    out[at // wide, at % wide] = np.frombuffer(raw, "<f8", n, 8 + 4 * n)
    return out


def meeting(left: DataFrame, right: DataFrame, keys: dict[str, int], tiles: tuple[int, int], nbytes: int) -> DataFrame:
    """Tiles of two sides so dealt that each of one meets each of the other with the same ``keys`` in some task.

    Both have ``keys``, with their extents, a number ``t`` and ``cells``; ``tiles``
    are their numbers of tiles, of ``nbytes`` each.  Tiles stand in groups, and a
    pair of groups is one value of ``g``: first the right ones (side 0), which a
    task may hold, then the left ones, both in order.  So a tile is sent once for
    each group of the other side, however many tiles there are.
    """
    m, n = tiles
    gm, gn = min(m, GROUPS), min(n, GROUPS)
    gm, gn = min(m, max(gm, GROUPS * GROUPS // gn)), min(n, max(gn, GROUPS * GROUPS // gm))
    gn = max(gn, min(n, -(-n * nbytes // HELD_BYTES)))
    wide_m, wide_n = -(-m // gm), -(-n // gn)
    number = position([F.col(k) for k in keys], list(keys.values())) if keys else F.lit(0).cast("long")
    g = (number * gm + F.col("gi")) * gn + F.col("gj")
    a = left.select(*keys, "t", "cells", F.expr(f"t div {wide_m}").alias("gi"), F.explode(F.sequence(F.lit(0), F.lit(gn - 1))).alias("gj"), F.lit(1).alias("side"))
    b = right.select(*keys, "t", "cells", F.explode(F.sequence(F.lit(0), F.lit(gm - 1))).alias("gi"), F.expr(f"t div {wide_n}").alias("gj"), F.lit(0).alias("side"))
    return dealt(a.unionByName(b).select(g.alias("g"), "side", "t", *keys, "cells"), size(list(keys.values())) * gm * gn)


def dealt(df: DataFrame, groups: int) -> DataFrame:
    """Rows by group ``g``, ``side`` and ``t``; few groups have a partition each, as their work is large for their bytes."""
    df = df.repartitionById(groups, F.col("g").cast("int")) if groups <= OWN_PARTITIONS else df.repartition("g")
    return df.sortWithinPartitions("g", "side", "t")


def _product(a: DataFrame, b: DataFrame, batch: int, m: int, n: int, depth: int) -> DataFrame:
    """(p, m, n, v) of the batched product of cells (p, m, k, v) and (p, n, k, v)."""
    deep, batch_rows = min(TILE_DEPTH, depth), TILE_ROWS
    tiles = -(-m // TILE_ROWS), -(-n // TILE_ROWS)
    left = tiled(a, F.col("m"), F.col("k"), "v", ["p"], TILE_ROWS if m > TILE_ROWS else m, deep).withColumnRenamed("ti", "t")
    right = tiled(b, F.col("n"), F.col("k"), "v", ["p"], TILE_ROWS if n > TILE_ROWS else n, deep).withColumnRenamed("ti", "t")

    def pack(out):
        values = np.concatenate([x[3] for x in out])
        ends = np.cumsum([0, *(len(x[3]) for x in out)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), lists], ["p", "ti", "tj", "values"])

    def multiply(batches):
        now, held, out, total = None, [], [], 0
        for part in batches:
            g, side, t, p, tk = (part.column(c).to_pylist() for c in range(5))
            for k in range(part.num_rows):
                if g[k] != now:
                    now, held = g[k], []
                own = min(deep, depth - tk[k] * deep)
                rows = min(batch_rows, (m if side[k] else n) - t[k] * batch_rows)
                x = dense(part.column(5)[k].as_buffer(), rows, own, deep)
                if side[k] == 0:
                    held.append((t[k], x.copy()))
                    continue
                for tj, y in held:
                    out.append((p[k], t[k], tj, (x @ y.T).ravel()))
                    total += len(out[-1][3])
                    if total >= OUT_VALUES:
                        yield pack(out)
                        out, total = [], 0
        if out:
            yield pack(out)

    met = meeting(left, right, {"p": batch, "tk": -(-depth // deep)}, tiles, 8 * TILE_ROWS * deep)
    made = met.mapInArrow(multiply, "p long, ti int, tj int, values array<double>")
    wide = F.least(F.lit(TILE_ROWS).cast("long"), F.lit(n).cast("long") - F.col("tj") * TILE_ROWS)
    cells = made.select("p", (F.col("ti").cast("long") * TILE_ROWS).alias("_m"), (F.col("tj").cast("long") * TILE_ROWS).alias("_n"), wide.alias("_w"), F.posexplode("values").alias("_at", "v"))
    out = cells.select("p", (F.col("_m") + F.expr("_at div _w")).alias("m"), (F.col("_n") + F.col("_at") % F.col("_w")).alias("n"), "v")
    return out if depth <= TILE_DEPTH else out.groupBy("p", "m", "n").agg(F.sum("v").alias("v"))


def einsum(equation: str, *operands: TensorRef, order: str = "unspecified") -> TensorRef:
    """Letters that the output lacks are summed; a letter twice in a term is a diagonal.

    Operands are contracted greedily, the pair that shares letters and whose
    result is smallest first, and letters that are needed no more are summed
    at once.  A term with one letter of extent one is joined like any other.
    """
    if "->" not in equation or "." in equation:
        raise ValueError("einsum needs '->' and no ellipsis")
    left, out = equation.replace(" ", "").split("->")
    terms = left.split(",")
    if len(terms) != len(operands) or any(len(t) != o.rank for t, o in zip(terms, operands, strict=True)):
        raise ValueError(f"{equation!r} does not fit the operands")
    extents: dict[str, int] = {}
    for t, o in zip(terms, operands, strict=True):
        for letter, n in zip(t, o.shape, strict=True):
            if extents.setdefault(letter, n) != n:
                raise ValueError(f"letter {letter!r} is {extents[letter]} and {n}")
    if len(set(out)) != len(out) or any(letter not in extents for letter in out):
        raise ValueError(f"bad output {out!r}")
    parts: list[tuple[str, DataFrame]] = []
    for t, o in zip(terms, operands, strict=True):
        df = o.indexed("c")
        letters = ""
        for k, letter in enumerate(t):
            if letter in letters:
                df = df.where(F.col(f"c{k}") == F.col(f"x_{letter}"))
            else:
                df = df.withColumn(f"x_{letter}", F.col(f"c{k}"))
                letters += letter
        parts.append((letters, df.select(*(f"x_{x}" for x in letters), "v")))

    def summed(letters: str, df: DataFrame, needed: str) -> tuple[str, DataFrame]:
        kept = "".join(x for x in letters if x in needed)
        if kept == letters:
            return letters, df
        if order == "unspecified":
            value = F.sum("v")
        else:
            gone = [f"x_{x}" for x in letters if x not in needed]
            values = F.transform(F.array_sort(F.collect_list(F.struct(*gone, "v"))), lambda s: s["v"])
            value = {"kahan": S.kahan_sum, "sequential": S.ordered_sum, "pairwise": S.pairwise_sum}[order](values)
        return kept, df.groupBy(*(f"x_{x}" for x in kept)).agg(value.alias("v"))

    while len(parts) > 1:

        def cost(i: int, j: int) -> tuple[bool, int]:
            rest = out + "".join(p[0] for k, p in enumerate(parts) if k not in (i, j))
            letters = set(parts[i][0]) | set(parts[j][0])
            return not set(parts[i][0]) & set(parts[j][0]), size([extents[x] for x in letters if x in rest])

        i, j = min(((i, j) for i in range(len(parts)) for j in range(i + 1, len(parts))), key=lambda p: cost(*p))
        (la, a), (lb, b) = parts[i], parts[j]
        rest = out + "".join(p[0] for k, p in enumerate(parts) if k not in (i, j))
        (la, a), (lb, b) = summed(la, a, rest + lb), summed(lb, b, rest + la)
        both = _by_tiles(la, a, lb, b, rest, extents) if order == "unspecified" else None
        if both is not None:
            parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [both]
            continue
        shared = [f"x_{x}" for x in la if x in lb]
        b = b.withColumnRenamed("v", "w")
        joined = a.join(b, shared) if shared else a.crossJoin(b)  # an outer product
        letters = la + "".join(x for x in lb if x not in la)
        joined = joined.select(*(f"x_{x}" for x in letters), (F.col("v") * F.col("w")).alias("v"))
        parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [summed(letters, joined, rest)]
    letters, df = summed(*parts[0], out)
    shape = tuple(extents[x] for x in out)
    to = operands[0].dtype
    for o in operands[1:]:
        to = wider(to, o.dtype)
    pos = position([F.col(f"x_{x}") for x in out], shape) if out else F.lit(0).cast("long")
    return TensorRef(df.select(pos.alias("pos"), "v"), shape, F.col("v"), to).rounded()


def _by_tiles(la: str, a: DataFrame, lb: str, b: DataFrame, rest: str, extents: dict[str, int]) -> tuple[str, DataFrame] | None:
    """The contraction of two terms as a batched product, where it is large enough."""
    batch = [x for x in la if x in lb and x in rest]
    gone = [x for x in la if x in lb and x not in rest]
    left, right = [x for x in la if x not in lb], [x for x in lb if x not in la]
    shape = {name: [extents[x] for x in letters] for name, letters in (("p", batch), ("k", gone), ("m", left), ("n", right))}
    if not gone or not (left or right) or size([*shape["p"], *shape["k"], *shape["m"], *shape["n"]]) < TILED_TERMS:
        return None

    def number(letters: list[str], name: str) -> Column:
        return (position([F.col(f"x_{x}") for x in letters], shape[name]) if letters else F.lit(0).cast("long")).alias(name)

    x = a.select(number(batch, "p"), number(left, "m"), number(gone, "k"), "v")
    y = b.select(number(batch, "p"), number(right, "n"), number(gone, "k"), "v")
    got = _product(x, y, size(shape["p"]), size(shape["m"]), size(shape["n"]), size(shape["k"]))
    columns = []
    for letters, name in ((batch, "p"), (left, "m"), (right, "n")):
        for letter, step in zip(letters, strides(shape[name]), strict=True):
            columns.append(F.expr(f"({name} div {step}L) % {extents[letter]}L").alias(f"x_{letter}"))
    return "".join(batch + left + right), got.select(*columns, "v")


_BATCH = "ABCDEFGH"


def matmul(a: TensorRef, b: TensorRef, order: str = "unspecified") -> TensorRef:
    """Batched product of the last two axes; batch axes broadcast as NumPy's do."""
    if a.rank < 2 or b.rank < 2 or a.shape[-1] != b.shape[-2]:
        raise ValueError(f"cannot multiply {a.shape} by {b.shape}")
    batch = broadcast_shape(a.shape[:-2] or (1,), b.shape[:-2] or (1,)) if a.rank > 2 or b.rank > 2 else ()
    if batch:
        a, b = (broadcast_to(t, (*batch, *t.shape[-2:])) for t in (a, b))
    letters = _BATCH[: len(batch)]
    return einsum(f"{letters}mk,{letters}kn->{letters}mn", a, b, order=order)


def linear(x: TensorRef, weight: TensorRef, bias: TensorRef | None = None) -> TensorRef:
    """x @ weight^T, plus a bias."""
    from .elementwise import add
    from .structure import transpose

    flat = reshape(x, (-1, x.shape[-1])) if x.rank > 1 else reshape(x, (1, -1))
    out = reshape(matmul(flat, transpose(weight)), (*x.shape[:-1], weight.shape[0]))
    return out if bias is None else add(out, bias)
