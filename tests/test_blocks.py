"""Operators that work in tiles, blocks and chunks, at sizes that need several of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import codecs
from tensorloom.operators import contract, delta, merge, nn, objects, quant, reduce, windowed
from tensorloom.plans import expr as E
from tensorloom.tensor import collect, from_cells, literal

RNG = np.random.default_rng(0)


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(contract, "TILE_ROWS", 5)
    monkeypatch.setattr(contract, "TILE_DEPTH", 7)
    monkeypatch.setattr(contract, "TILED_TERMS", 1)


@pytest.mark.parametrize("equation,shapes", [("ik,kj->ij", [(12, 20), (20, 11)]), ("bik,bjk->bij", [(3, 6, 9), (3, 7, 9)]), ("ik,jk->ji", [(6, 15), (9, 15)]), ("aik,ka->ia", [(2, 6, 8), (8, 2)]), ("ri,rj,ij->r", [(6, 8), (6, 9), (8, 9)]), ("ik,k->i", [(13, 16), (16,)])])
def test_tiled_contraction(spark, small_tiles, equation, shapes):
    arrays = [RNG.normal(size=s) for s in shapes]
    got = collect(contract.einsum(equation, *(literal(spark, a) for a in arrays)))
    assert np.allclose(got, np.einsum(equation, *arrays))


@pytest.mark.parametrize("order", ["sequential", "kahan", "pairwise"])
def test_pinned_sums(spark, order):
    a, b = RNG.normal(size=(4, 9)), RNG.normal(size=(9, 3))
    assert np.allclose(collect(contract.matmul(literal(spark, a), literal(spark, b), order)), a @ b)
    assert np.allclose(collect(reduce.reduce(literal(spark, a), "sum", [1], order=order)), a.sum(axis=1))


def _attention(q, k, v, causal, window, groups):
    out = np.zeros((*q.shape[:3], v.shape[3]))
    m, n = q.shape[2], k.shape[2]
    for b, h, i in np.ndindex(q.shape[:3]):
        s = k[b, h // groups] @ q[b, h, i] / np.sqrt(q.shape[3])
        at, place = np.arange(n), i + n - m
        seen = np.ones(n, bool)
        if causal:
            seen &= at <= place
        if window:
            seen &= at > place - window
        if seen.any():
            p = np.exp(s[seen] - s[seen].max())
            out[b, h, i] = p / p.sum() @ v[b, h // groups][seen]
    return out


@pytest.mark.parametrize("causal,window,groups,m,n", [(False, None, 1, 9, 13), (True, None, 2, 9, 13), (True, 3, 1, 13, 13), (True, 2, 1, 13, 9), (False, 4, 1, 7, 17)])
def test_attention_in_blocks(spark, monkeypatch, causal, window, groups, m, n):
    monkeypatch.setattr(nn, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(nn, "BLOCK_KEYS", 3)
    q, k, v = RNG.normal(size=(2, 2, m, 4)), RNG.normal(size=(2, 2 // groups, n, 4)), RNG.normal(size=(2, 2 // groups, n, 5))
    got = collect(nn.attention(*(literal(spark, a) for a in (q, k, v)), causal=causal, window=window, kv_groups=groups))
    assert np.allclose(got, _attention(q, k, v, causal, window, groups))


@pytest.mark.parametrize("reverse", [False, True])
def test_scan_in_chunks(spark, monkeypatch, reverse):
    monkeypatch.setattr(windowed, "SCAN_CELLS", 4)
    a = RNG.normal(size=(3, 15))
    want, h = np.zeros_like(a), np.zeros(3)
    for t in reversed(range(15)) if reverse else range(15):
        h = 0.7 * h + a[:, t]
        want[:, t] = h
    assert np.allclose(collect(windowed.scan_sum(literal(spark, a), 0.7, reverse=reverse)), want)


def _ranges(spark, rows, gap, most):
    df = spark.createDataFrame([("s", a, n) for a, n in rows], "source string, offset long, length long")
    return sorted((r.offset, r.length) for r in objects.coalesce_ranges(df, gap=gap, most=most).collect())


def test_ranges(spark):
    far = 1 << 30
    assert _ranges(spark, [(0, 10), (10, 10)], 0, far) == [(0, 20)] and _ranges(spark, [(0, 10), (5, 10)], 0, far) == [(0, 15)]
    assert _ranges(spark, [(0, 10), (4106, 10)], 4096, far) == [(0, 4116)] and _ranges(spark, [(0, 10), (4107, 10)], 4096, far) == [(0, 10), (4107, 10)]
    assert _ranges(spark, [(20, 10), (0, 10), (5, 0)], 0, far) == [(0, 10), (20, 10)] and _ranges(spark, [(0, 10), (10, 10)], 0, 15) == [(0, 10), (10, 10)]
    assert _ranges(spark, [(0, 19_990), (19_990, 5000)], 0, 20_000) == [(0, 19_990), (19_990, 5000)]


@pytest.mark.parametrize("seed", range(3))
def test_least_kept(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(k, float(x)) for k in range(2) for x in np.concatenate([rng.integers(0, 5, 30) / 4, 10.0 ** rng.integers(-8, 8, 20)])]
    df = spark.createDataFrame(rows, "k int, m double")
    for keep in (1, 7, 50):
        want = [sorted((m for kk, m in rows if kk == k), reverse=True)[keep - 1] for k in range(2)]
        assert merge._least_kept(df, 2, keep) == want


def test_chains(spark):
    rows = [("c", "b", True), ("b", "a", True), ("a", None, True), ("y", "x", False), ("z", "gone", True)]
    df = spark.createDataFrame(rows, "digest string, parent string, required boolean")
    chain = lambda start: [(r.depth, r.digest, r.status) for r in delta.resolve_chain(df, start).orderBy("depth").collect()]
    assert chain("c") == [(0, "c", "present"), (1, "b", "present"), (2, "a", "present")]
    assert chain("y") == [(0, "y", "present"), (1, "x", "absent")] and chain("z") == [(0, "z", "present"), (1, "gone", "incomplete")]
    with pytest.raises(ValueError):
        delta.resolve_chain(df, "c", limit=1)


def test_digests_are_of_encoded_bytes(spark):
    import hashlib

    a = RNG.normal(size=300)
    cells = literal(spark, a).cells().selectExpr("'t' as tensor", "pos", "v")
    whole = delta.chunk_digests(cells, chunk=1 << 62, to="f32").collect()
    assert [r.digest for r in whole] == [hashlib.sha256(a.astype("<f4").tobytes()).hexdigest()]
    parts = {r.seq: r.digest for r in delta.chunk_digests(cells, chunk=128).collect()}
    assert parts == {k: hashlib.sha256(a[128 * k : 128 * k + 128].tobytes()).hexdigest() for k in range(3)}


def test_words_and_codecs(spark):
    fields = from_cells(spark.createDataFrame([(i, float(i * 7 % 16)) for i in range(16)], "pos long, v double"), (16,))
    words = quant.pack_words(fields.cells(), 4, order=quant.AWQ_ORDER)
    back = quant.unpack_words(words, 4, order=quant.AWQ_ORDER)
    assert {r.pos: r.v for r in back.collect()} == {i: float(i * 7 % 16) for i in range(16)}
    raw = RNG.bytes(1003)
    assert codecs.unshuffle_bits(codecs.shuffle_bits(raw, 4), 4) == raw and codecs.shuffle_bits(b"\x01" + b"\0" * 7, 1) == b"\x01" + b"\0" * 7
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "b binary")
    with pytest.raises(Exception):  # noqa: B017
        df.select(codecs.decode(codecs.encode(F.col("b"), "zlib"), "zlib", most=100)).collect()
    got = df.select(codecs.decode(codecs.encode(F.col("b"), "zstd"), "zstd").alias("b")).collect()
    assert [None if r.b is None else bytes(r.b) for r in got] == [raw, None]


def test_kept_results_are_bounded(spark):
    x = E.node("literal", source="x", shape=[4], dtype="f64")
    ctx = E.Context(spark, {"x": literal(spark, [1.0, 2, 3, 4]).cells()}, most_bytes=130)
    a, b, c = (E.node("scale", x, k=k) for k in (2, 3, 5))
    first = ctx.keep(a)
    ctx.keep(b)
    assert ctx.keep(a) is first  # used again, so b is the oldest
    ctx.keep(c)
    assert len(ctx.kept) == 2 and E.identity(b) not in ctx.kept and E.identity(a) in ctx.kept
