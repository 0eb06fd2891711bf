"""Neural-network operators as compositions of joins, windows and aggregates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..functions.dtypes import dtype
from ..tensor import TensorRef, position, size
from .contract import HELD_BYTES, dealt, dense, einsum, matmul, meeting, tiled
from .elementwise import combine
from .windowed import softmax, topk


#: Queries and keys of a block.
BLOCK_QUERIES, BLOCK_KEYS = 256, 512
#: Groups of queries a head, each of which meets its keys in one task; more only where a group would pass the bytes that a task holds.
GROUPS_QUERIES = 16


def _attended(q: TensorRef, k: TensorRef, v: TensorRef, factor: float, causal: bool, window: int | None, softcap: float | None, groups: int) -> DataFrame:
    """pos and v of attention in blocks.

    A group of queries stays in its task with the largest score, the sum of
    weights and the weighted sum of values so far, and those blocks of keys that
    hold a key it may see stream past it in order.  So a key is sent once for
    each group that sees it, and no partial result is sent at all.
    """
    b, h, m, d = q.shape
    n, e = k.shape[2], v.shape[3]
    wide = max(d, e)
    blocks = -(-m // BLOCK_QUERIES)
    most = max(1, HELD_BYTES // (8 * BLOCK_QUERIES * (d + e + 2)))
    each = min(most, -(-blocks // min(blocks, GROUPS_QUERIES)))  # blocks of queries in a group
    parts = -(-blocks // each)
    span, step, held_keys = each * BLOCK_QUERIES, BLOCK_QUERIES, BLOCK_KEYS
    asked = q.indexed().select(F.col("i0").alias("b"), F.col("i1").alias("h"), F.col("i2").alias("i"), F.col("i3").alias("c"), "v")
    asked = tiled(asked, F.col("i"), F.col("c"), "v", ["b", "h"], BLOCK_QUERIES, d)
    asked = asked.select("b", "h", F.expr(f"ti div {each}").alias("gi"), F.lit(0).alias("side"), F.col("ti").alias("t"), "cells")
    held = None
    for tag, t in ((0, k), (1, v)):
        part = t.indexed().select(F.col("i0").alias("b"), F.col("i1").alias("g"), F.col("i2").alias("j"), (F.col("i3") + tag * wide).alias("c"), "v")
        held = part if held is None else held.unionByName(part)
    held = tiled(held, F.col("j"), F.col("c"), "v", ["b", "g"], BLOCK_KEYS, 2 * wide)
    first = F.col("ti").cast("long") * BLOCK_KEYS - (n - m)  # the query that stands at the block's first key
    low = F.greatest(F.floor(first / span), F.lit(0)) if causal else F.lit(0)
    high = F.least(F.floor((first + BLOCK_KEYS + window - 2) / span), F.lit(parts - 1)) if window else F.lit(parts - 1)
    held = held.select("*", low.cast("int").alias("_low"), high.cast("int").alias("_high")).where("_low <= _high")
    heads = F.explode(F.sequence(F.col("g") * groups, F.col("g") * groups + (groups - 1)))
    held = held.select("b", heads.alias("h"), "ti", "cells", "_low", "_high").select("b", "h", F.explode(F.sequence("_low", "_high")).alias("gi"), F.lit(1).alias("side"), F.col("ti").alias("t"), "cells")

    def out(key, blocks_held):
        bb, hh = key
        values = [np.where((total == 0)[:, None], 0.0, sums / np.where(total == 0, 1.0, total)[:, None]).ravel() for _, _, _, total, sums in blocks_held]
        ids = [x[0] for x in blocks_held]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values)))
        return pa.RecordBatch.from_arrays([pa.array([bb] * len(ids), pa.int64()), pa.array([hh] * len(ids), pa.int64()), pa.array(ids, pa.int32()), lists], ["b", "h", "ti", "values"])

    def meet(block, tj, y):
        """Add a block of keys to a block of queries."""
        ti, x, top, total, sums = block
        rows, columns = len(x), len(y)
        place = ti * step + n - m + np.arange(rows)
        at = tj * held_keys + np.arange(columns)
        if (causal and at[0] > place[-1]) or (window and at[-1] <= place[0] - window):
            return
        s = x @ y[:, :d].T
        if softcap:
            s = np.tanh(s * (factor / softcap)) * softcap
        else:
            s *= factor
        if causal and at[-1] > place[0]:
            s[at[None] > place[:, None]] = -np.inf
        if window and at[0] <= place[-1] - window:
            s[at[None] <= place[:, None] - window] = -np.inf
        both = np.maximum(top, s.max(axis=1))
        base = np.where(np.isneginf(both), 0.0, both)
        s -= base[:, None]
        np.exp(s, out=s)
        old = np.exp(top - base)
        top[:] = both
        total *= old
        total += s.sum(axis=1)
        sums *= old[:, None]
        sums += s @ y[:, wide : wide + e]

    def attend(batches):
        now, asked_held = None, []
        for batch in batches:
            g, side, t, bb, hh = (batch.column(c).to_pylist() for c in range(5))
            for r in range(batch.num_rows):
                if g[r] != now:
                    if asked_held:
                        yield out(whose, asked_held)
                    now, asked_held, whose = g[r], [], (bb[r], hh[r])
                raw = batch.column(5)[r].as_buffer()
                if side[r] == 0:
                    x = dense(raw, min(step, m - t[r] * step), d, d).copy()
                    asked_held.append((t[r], x, np.full(len(x), -np.inf), np.zeros(len(x)), np.zeros((len(x), e))))
                    continue
                y = dense(raw, min(held_keys, n - t[r] * held_keys), 2 * wide, 2 * wide)
                for block in asked_held:
                    meet(block, t[r], y)
        if asked_held:
            yield out(whose, asked_held)

    g = (F.col("b") * h + F.col("h")) * parts + F.col("gi")
    met = dealt(asked.unionByName(held).select(g.alias("g"), "side", "t", "b", "h", "cells"), b * h * parts)
    done = met.mapInArrow(attend, "b long, h long, ti int, values array<double>")
    base = ((F.col("b") * h + F.col("h")) * m + F.col("ti").cast("long") * BLOCK_QUERIES) * e
    return done.select(base.alias("_base"), F.posexplode("values").alias("_at", "v")).select((F.col("_base") + F.col("_at")).alias("pos"), "v")


def attention(
    q: TensorRef,
    k: TensorRef,
    v: TensorRef,
    mask: TensorRef | None = None,
    *,
    causal: bool = False,
    window: int | None = None,
    softcap: float | None = None,
    kv_groups: int = 1,
    scale: float | None = None,
) -> TensorRef:
    """Scaled dot-product attention over [batch, heads, length, depth].

    With ``kv_groups`` each key head serves that many query heads.  Queries
    stand at the end of the keys.  ``window`` keeps that many latest keys.  A
    query without a key left gives zeros.  Without a mask the work is done in
    blocks of queries and keys; with one, scores are joined with it.
    """
    if q.rank != 4 or k.rank != 4 or v.rank != 4:
        raise ValueError("attention takes [batch, heads, length, depth]")
    b, h, m, d = q.shape
    n, e = k.shape[2], v.shape[3]
    if k.shape[1] * kv_groups != h or k.shape[3] != d or v.shape[:3] != k.shape[:3]:
        raise ValueError(f"heads or depths of {q.shape}, {k.shape}, {v.shape} do not fit")
    factor = scale if scale is not None else 1 / math.sqrt(d)
    if mask is None:
        return q.with_cells(_attended(q, k, v, factor, causal, window, softcap, kv_groups), (b, h, m, e)).rounded()
    left = q.indexed().select(F.col("i0").alias("b"), F.col("i1").alias("h"), F.expr(f"i1 div {kv_groups}L").alias("g"), F.col("i2").alias("i"), F.col("i3").alias("d"), F.col("v").alias("x"))
    right = k.indexed().select(F.col("i0").alias("b"), F.col("i1").alias("g"), F.col("i2").alias("j"), F.col("i3").alias("d"), F.col("v").alias("y"))
    scores = left.join(right, ["b", "g", "d"]).groupBy("b", "h", "g", "i", "j").agg((F.sum(F.col("x") * F.col("y")) * factor).alias("s"))
    if softcap:
        scores = scores.withColumn("s", F.tanh(F.col("s") / softcap) * softcap)
    place = F.col("i") + (n - m)
    if causal:
        scores = scores.where(F.col("j") <= place)
    if window:
        scores = scores.where(F.col("j") > place - window)
    if mask is not None:
        shape = (b, h, m, n)
        at = position([F.col(c) if extent > 1 else F.lit(0) for c, extent in zip("bhij", (1,) * (4 - mask.rank) + mask.shape, strict=True)], (1,) * (4 - mask.rank) + mask.shape)
        own = mask.cells().select(F.col("pos").alias("at"), F.col("v").alias("m"))
        scores = scores.withColumn("at", at).join(own, "at").withColumn("s", F.col("s") + F.col("m")).where(F.col("s") > S.lit(-S.INF)).drop("at", "m")
        assert len(shape) == 4
    row = Window.partitionBy("b", "h", "i")
    scores = scores.withColumn("p", F.exp(F.col("s") - F.max("s").over(row)))
    weights = scores.withColumn("p", F.col("p") / F.sum("p").over(row))
    values = v.indexed().select(F.col("i0").alias("b"), F.col("i1").alias("g"), F.col("i2").alias("j"), F.col("i3").alias("e"), F.col("v").alias("y"))
    out = weights.join(values, ["b", "g", "j"]).groupBy("b", "h", "i", "e").agg(F.sum(F.col("p") * F.col("y")).alias("v"))
    shape = (b, h, m, e)
    out = out.select(position([F.col(c) for c in "bhie"], shape).alias("pos"), "v")
    grid = q.spark.range(size(shape)).select(F.col("id").alias("pos"))
    return q.with_cells(grid.join(out, "pos", "left").select("pos", F.coalesce("v", S.lit(0)).alias("v")), shape).rounded()


def rope(x: TensorRef, positions: TensorRef | None = None, *, theta: float = 10000.0, interleaved: bool = False) -> TensorRef:
    """Rotary embedding of [..., length, depth]: pairs (2k, 2k+1) or (k, k + depth/2)."""
    d = x.shape[-1]
    if d % 2:
        raise ValueError(f"rope of an odd depth {d}")
    half = d // 2
    c, i = F.col(f"i{x.rank - 1}"), F.col(f"i{x.rank - 2}")
    df = x.indexed()
    pair = F.expr(f"i{x.rank - 1} div 2L") if interleaved else c % half
    second = c % 2 == 1 if interleaved else c >= half
    df = df.withColumn("pair", pair).withColumn("second", second).withColumn("at", i)
    if positions is not None:
        own = positions.cells().select(F.col("pos").alias("at"), F.col("v").alias("where"))
        df = df.join(own, "at")
    else:
        df = df.withColumn("where", F.col("at").cast("double"))
    rest = [f"i{k}" for k in range(x.rank - 1)]
    both = df.groupBy(*rest, "pair", "where").agg(F.max(F.when(~F.col("second"), F.col("v"))).alias("a"), F.max(F.when(F.col("second"), F.col("v"))).alias("b"))
    angle = F.col("where") * F.pow(S.lit(theta), -2.0 * F.col("pair") / d)
    a, b = F.col("a"), F.col("b")
    turned = F.array(F.struct((F.col("pair") * 2 if interleaved else F.col("pair")).alias("c"), (a * F.cos(angle) - b * F.sin(angle)).alias("v")), F.struct((F.col("pair") * 2 + 1 if interleaved else F.col("pair") + half).alias("c"), (a * F.sin(angle) + b * F.cos(angle)).alias("v")))
    out = both.select(*rest, F.explode(turned).alias("t"))
    return x.with_cells(out.select(position([*(F.col(r) for r in rest), F.col("t.c")], x.shape).alias("pos"), F.col("t.v").alias("v"))).rounded()


def moe_route(x: TensorRef, w: TensorRef, *, top_k: int, normalize: bool = False) -> tuple[TensorRef, TensorRef]:
    """Weights and indices of the best experts of each token, softmax over all of them."""
    if x.rank != 2 or w.rank != 2 or x.shape[1] != w.shape[0]:
        raise ValueError(f"route {x.shape} by {w.shape}")
    weights, index = topk(softmax(matmul(x, w)), top_k)
    if normalize:
        df = weights.indexed()
        df = df.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("i0")))
        weights = weights.with_cells(df.select("pos", "v"))
    return weights, index


def ssm_scan(u: TensorRef, delta: TensorRef, a: TensorRef, b: TensorRef, c: TensorRef, d: TensorRef | None = None, *, delta_softplus: bool = False, reverse: bool = False) -> TensorRef:
    """Selective scan: h_t = exp(delta A) h + delta B u, y = C h (+ D u).

    u and delta are [batch, channels, length], a is [channels, states], b and c
    are [batch, states, length], d is [channels].  Each (batch, channel, state)
    folds its own time axis in order, streaming through its partition.
    """
    batch, p, length = u.shape
    n = a.shape[1]
    if delta.shape != u.shape or a.shape[0] != p or b.shape != (batch, n, length) or c.shape != b.shape:
        raise ValueError("shapes of the scan do not fit")
    dt = delta.map(S.softplus) if delta_softplus else delta
    steps = combine(lambda x, y: F.struct(x.alias("u"), y.alias("dt")), u, dt).df.select("pos", F.col("v0").alias("u"), F.col("v1").alias("dt")) if u.df is not dt.df else u.df.select("pos", u.v.alias("u"), dt.v.alias("dt"))
    steps = steps.select(F.expr(f"pos div {p * length}L").alias("b"), F.expr(f"(pos div {length}L) % {p}L").alias("p"), (F.col("pos") % length).alias("t"), "u", "dt")
    states = a.indexed().select(F.col("i0").alias("p"), F.col("i1").alias("n"), F.col("v").alias("a"))
    inputs = b.indexed().select(F.col("i0").alias("b"), F.col("i1").alias("n"), F.col("i2").alias("t"), F.col("v").alias("bb"))
    outs = c.indexed().select(F.col("i0").alias("b"), F.col("i1").alias("n"), F.col("i2").alias("t"), F.col("v").alias("cc"))
    terms = steps.join(states, "p").join(inputs, ["b", "n", "t"]).join(outs, ["b", "n", "t"])
    key = -F.col("t") if reverse else F.col("t")
    item = F.struct(key.alias("k"), "t", F.exp(F.col("dt") * F.col("a")).alias("keep"), (F.col("dt") * F.col("bb") * F.col("u")).alias("put"), F.col("cc").alias("c"))

    def fold(batches):
        now, state = None, 0.0
        for batch in batches:
            bb, pp, nn, _, tt, keep, put, cc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            y = np.empty(len(bb))
            for i, (key, f, x) in enumerate(zip(zip(bb.tolist(), pp.tolist(), nn.tolist(), strict=True), keep.tolist(), put.tolist(), strict=True)):
                state = state * f + x if key == now else x
                now = key
                y[i] = state
            yield pa.RecordBatch.from_arrays([pa.array(bb), pa.array(pp), pa.array(tt), pa.array(y * cc)], ["b", "p", "t", "y"])

    flat = terms.select("b", "p", "n", item.alias("item")).select("b", "p", "n", "item.*")
    lanes = flat.repartition("b", "p", "n").sortWithinPartitions("b", "p", "n", "k")
    y = lanes.mapInArrow(fold, "b long, p long, t long, y double").groupBy("b", "p", "t").agg(F.sum("y").alias("v"))
    out = u.with_cells(y.select(position([F.col(x) for x in "bpt"], u.shape).alias("pos"), "v"))
    if d is not None:
        from .structure import reshape

        out = combine(lambda x, uu, dd: x + uu * dd, out, u, reshape(d, (p, 1)), to=u.dtype)
    return out.rounded()


def conv(x: TensorRef, w: TensorRef, bias: TensorRef | None = None, *, stride: Sequence[int] | None = None, padding: Sequence[int] | None = None, dilation: Sequence[int] | None = None, groups: int = 1, low_only: bool = False) -> TensorRef:
    """Cross-correlation of [n, channels, ...] with [out, channels/groups, ...].

    Each kernel tap names the input cell that it meets, so the join is an
    equi-join; taps in the padding meet none and add nothing.
    """
    r = x.rank - 2
    stride, padding, dilation = list(stride or [1] * r), list(padding or [0] * r), list(dilation or [1] * r)
    n, ci = x.shape[:2]
    co, cg = w.shape[:2]
    if w.rank != x.rank or ci % groups or co % groups or cg != ci // groups:
        raise ValueError(f"channels of {x.shape} and {w.shape} in {groups} groups")
    outs = []
    for k in range(r):
        reach = dilation[k] * (w.shape[2 + k] - 1) + 1
        extent = (x.shape[2 + k] + (1 if low_only else 2) * padding[k] - reach) // stride[k] + 1
        if extent < 1:
            raise ValueError("the kernel is larger than the padded input")
        outs.append(extent)
    cells = x.indexed("x").select("x0", F.expr(f"x1 div {ci // groups}L").alias("g"), (F.col("x1") % (ci // groups)).alias("c"), *(f"x{k + 2}" for k in range(r)), "v")
    taps = w.indexed("w").select(F.col("w0").alias("oc"), F.expr(f"w0 div {co // groups}L").alias("g"), F.col("w1").alias("c"), *(f"w{k + 2}" for k in range(r)), F.col("v").alias("w"))
    met = cells.join(taps, ["g", "c"])
    for k in range(r):
        at = F.col(f"x{k + 2}") + padding[k] - F.col(f"w{k + 2}") * dilation[k]
        met = met.withColumn(f"a{k}", at).where((F.col(f"a{k}") >= 0) & (F.col(f"a{k}") % stride[k] == 0)).withColumn(f"o{k}", F.expr(f"a{k} div {stride[k]}L")).where(F.col(f"o{k}") < outs[k])
    shape = (n, co, *outs)
    got = met.groupBy("x0", "oc", *(f"o{k}" for k in range(r))).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    got = got.select(position([F.col("x0"), F.col("oc"), *(F.col(f"o{k}") for k in range(r))], shape).alias("pos"), "v")
    grid = x.spark.range(size(shape)).select(F.col("id").alias("pos"))
    y = x.with_cells(grid.join(got, "pos", "left").select("pos", F.coalesce("v", S.lit(0)).alias("v")), shape)
    if bias is not None:
        from .structure import reshape

        y = combine(lambda p, q: p + q, y, reshape(bias, (co, *([1] * r))), to=x.dtype)
    return y.rounded()


def conv1d_causal(x: TensorRef, w: TensorRef, bias: TensorRef | None = None, *, groups: int = 1) -> TensorRef:
    """Convolution along the last axis that sees no later input."""
    return conv(x, w, bias, padding=[w.shape[2] - 1], groups=groups, low_only=True)


def pool(x: TensorRef, kind: str, window: Sequence[int], stride: Sequence[int] | None = None) -> TensorRef:
    """Maximum or mean over windows of the trailing axes; partial windows are dropped."""
    if kind not in ("max", "avg"):
        raise ValueError(f"no pooling {kind!r}")
    r = x.rank - 2
    stride = list(stride or window)
    outs = [(x.shape[2 + k] - window[k]) // stride[k] + 1 for k in range(r)]
    df = x.indexed()
    for k in range(r):
        taps = F.array(*(F.lit(t).cast("long") for t in range(window[k])))
        df = df.withColumn("t", F.explode(taps)).withColumn("a", F.col(f"i{k + 2}") - F.col("t")).where((F.col("a") >= 0) & (F.col("a") % stride[k] == 0)).withColumn(f"o{k}", F.expr(f"a div {stride[k]}L")).where(F.col(f"o{k}") < outs[k])
    shape = (*x.shape[:2], *outs)
    value = S.max_agg(F.col("v")) if kind == "max" else F.avg("v")
    got = df.groupBy("i0", "i1", *(f"o{k}" for k in range(r))).agg(value.alias("v"))
    return x.with_cells(got.select(position([F.col("i0"), F.col("i1"), *(F.col(f"o{k}") for k in range(r))], shape).alias("pos"), "v"), shape).rounded()


#: Corners that meet their cells in one task.
MET_ROWS = 1 << 20


def interpolate(x: TensorRef, scale: Sequence[float], mode: str = "nearest") -> TensorRef:
    """Resample the trailing axes, half-pixel centres; nearest or linear over 2^d corners."""
    if mode not in ("nearest", "linear"):
        raise ValueError(f"no interpolation {mode!r}")
    r = x.rank - 2
    outs = [int(math.floor(x.shape[2 + k] * scale[k])) for k in range(r)]
    shape = (*x.shape[:2], *outs)
    grid = TensorRef(x.spark.range(size(shape)).select(F.col("id").alias("pos")), shape, S.lit(0), x.dtype)
    df = grid.df.withColumns({f"o{k}": c for k, c in enumerate(grid.coords())})
    choices = []
    for k in range(r):
        n = x.shape[2 + k]
        if scale[k] == 1:
            choices.append([(F.col(f"o{k + 2}"), S.lit(1))])
        elif mode == "nearest":
            at = F.least(F.floor(F.col(f"o{k + 2}") / float(scale[k])).cast("long"), F.lit(n - 1))
            choices.append([(at, S.lit(1))])
        else:
            real = F.greatest((F.col(f"o{k + 2}") + 0.5) / float(scale[k]) - 0.5, S.lit(0))
            low = F.least(F.floor(real).cast("long"), F.lit(n - 1))
            high = F.least(low + 1, F.lit(n - 1))
            part = F.least(real - low, S.lit(1))
            choices.append([(low, 1 - part), (high, part)])
    corners = []
    for corner in itertools.product(*choices):
        weight = S.lit(1)
        for _, p in corner:
            weight = weight * p
        corners.append(F.struct(position([F.col("o0"), F.col("o1"), *(c for c, _ in corner)], x.shape).alias("src"), weight.alias("w")))
    parts = max(1, -(-size(shape) * len(corners) // MET_ROWS))
    cells = x.cells().select(F.col("pos").alias("src"), "v").repartition(parts, "src")
    met = df.select("pos", F.explode(F.array(*corners)).alias("c")).select("pos", F.col("c.src").alias("src"), F.col("c.w").alias("w")).repartition(parts, "src").join(cells.hint("merge"), "src")
    return x.with_cells(met.groupBy("pos").agg(F.sum(F.col("v") * F.col("w")).alias("v")), shape).rounded()


def gnn_message(nodes: TensorRef, edges, *, source: str = "src", target: str = "dst") -> TensorRef:
    """Sum over edges of the source nodes' rows, per target node."""
    width = nodes.shape[1]
    rows = nodes.indexed().select(F.col("i0").alias("_s"), F.col("i1").alias("_c"), "v")
    got = edges.select(F.col(source).cast("long").alias("_s"), F.col(target).cast("long").alias("_t")).join(rows, "_s").groupBy("_t", "_c").agg(F.sum("v").alias("v"))
    grid = nodes.spark.range(size(nodes.shape)).select(F.col("id").alias("pos"))
    own = got.select((F.col("_t") * width + F.col("_c")).alias("pos"), "v")
    return nodes.with_cells(grid.join(own, "pos", "left").select("pos", F.coalesce("v", S.lit(0)).alias("v")))


#: Rows, and queries, of a block of a search.
BLOCK_SEARCH = 256


def cosine_topk(rows: TensorRef, queries: TensorRef, k: int) -> tuple[TensorRef, TensorRef]:
    """The k rows most alike to each query row, by cosine: scores and row numbers, ties by row.

    Each block of rows meets each block of queries once, and a task leaves the k
    best of its rows a query, so what is ranked at the end is small.
    """
    (n, d), m = rows.shape, queries.shape[0]
    if queries.shape[1] != d or not 0 < k <= n:
        raise ValueError(f"the {k} most alike of {rows.shape} to {queries.shape}")

    def blocks(t: TensorRef) -> DataFrame:
        cells = t.indexed().select(F.col("i0").alias("r"), F.col("i1").alias("c"), "v")
        return tiled(cells, F.col("r"), F.col("c"), "v", [], BLOCK_SEARCH, d).select(F.col("ti").alias("t"), "cells")

    block = BLOCK_SEARCH

    def unit(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def better(found: tuple, s: np.ndarray, first: int) -> tuple:
        """The k best of those found so far and of a block's scores; what is found stands in order of row on ties."""
        key = np.where(np.isnan(s), np.inf, np.round(s, 12))  # equal vectors tie, wherever in a block they stand
        row = np.broadcast_to(np.arange(s.shape[1]) + first, s.shape)
        near = np.argsort(-key, axis=1, kind="stable")[:, :k]
        both = [np.concatenate([a, np.take_along_axis(b, near, axis=1)], axis=1) for a, b in zip(found, (key, s, row), strict=True)]
        kept = np.argsort(-both[0], axis=1, kind="stable")[:, :k]
        return tuple(np.take_along_axis(x, kept, axis=1) for x in both)

    def best(batches):
        def out():
            for qi, x, (key, s, row) in held:
                asked = np.repeat(np.arange(len(x)) + qi * block, s.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(row.ravel()), pa.array(key.ravel()), pa.array(s.ravel())], ["q", "row", "key", "score"])

        now, held = None, []
        for batch in batches:
            g, side, t = (batch.column(c).to_pylist() for c in range(3))
            for r in range(batch.num_rows):
                if g[r] != now:
                    yield from out()
                    now, held = g[r], []
                x = unit(dense(batch.column(3)[r].as_buffer(), min(block, (n if side[r] else m) - t[r] * block), d, d))
                if side[r] == 0:
                    held.append((t[r], x, (np.empty((len(x), 0)), np.empty((len(x), 0)), np.empty((len(x), 0), dtype=np.int64))))
                else:
                    held = [(qi, asked, better(found, asked @ x.T, t[r] * block)) for qi, asked, found in held]
        yield from out()

    met = meeting(blocks(rows), blocks(queries), {}, (-(-n // block), -(-m // block)), 8 * block * d)
    met = met.mapInArrow(best, "q long, row long, key double, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("key"), "row")) - 1
    top = met.withColumn("rank", rank).where(F.col("rank") < k).select((F.col("q") * k + F.col("rank")).alias("pos"), "score", F.col("row").cast("double").alias("row"))
    return TensorRef(top, (m, k), F.col("score"), rows.dtype), TensorRef(top, (m, k), F.col("row"), INDEX)


INDEX = dtype("i32")
