"""Operators against NumPy on seeded tensors, with NaN, infinity and odd shapes; refusals by name."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tensorloom.operators import contract, elementwise, merge, nn, quant, reduce, sparse, structure, windowed
from tensorloom.tensor import collect, literal


def rng(seed=0):
    return np.random.default_rng(seed)


def ref(spark, a):
    return literal(spark, a)


@pytest.mark.parametrize("sa,sb", [((3, 4), (3, 4)), ((3, 4), (4,)), ((2, 1, 4), (2, 3, 1)), ((1, 3), (2, 1, 1))])
def test_broadcasting(spark, sa, sb):
    a, b = rng(1).normal(size=sa), rng(2).normal(size=sb)
    assert np.allclose(collect(elementwise.add(ref(spark, a), ref(spark, b))), a + b)
    assert np.allclose(collect(elementwise.mul(ref(spark, a), ref(spark, b))), a * b)


def test_chain_is_one_projection(spark):
    x = ref(spark, rng().normal(size=(4, 4)))
    y = elementwise.add(elementwise.mul(x, x), x)
    assert y.df is x.df


def test_special_values(spark):
    a, b = np.array([1.0, np.nan, np.inf, -np.inf, 0.0]), np.array([0.0, 1.0, np.inf, 2.0, 0.0])
    with np.errstate(all="ignore"):
        assert np.array_equal(collect(elementwise.div(ref(spark, a), ref(spark, b))), a / b, equal_nan=True)
    assert np.array_equal(collect(elementwise.maximum(ref(spark, a), ref(spark, b))), np.fmax(a, b), equal_nan=True)
    assert np.array_equal(collect(elementwise.clamp(ref(spark, a), -1, 1)), np.clip(a, -1, 1), equal_nan=True)


def test_structure(spark):
    a = rng().normal(size=(2, 3, 4))
    x = ref(spark, a)
    assert np.array_equal(collect(structure.permute(x, [2, 0, 1])), a.transpose(2, 0, 1))
    assert np.array_equal(collect(structure.slice_(x, [0, 1, 0], [2, 3, 4], [1, 1, 3])), a[:, 1:3, ::3])
    assert np.array_equal(collect(structure.concat([x, x], 1)), np.concatenate([a, a], 1))
    assert np.array_equal(collect(structure.split(x, 2, [1, 3], 1)), a[:, :, 1:])
    for mode, name in (("edge", "edge"), ("reflect", "reflect"), ("wrap", "wrap")):
        assert np.array_equal(collect(structure.pad(x, [0, 1, 2], [0, 1, 1], mode)), np.pad(a, [(0, 0), (1, 1), (2, 1)], name))
    assert np.array_equal(collect(structure.gather(x, ref(spark, [[2, 0], [1, 1]]), 1)), a[:, [[2, 0], [1, 1]]])
    with pytest.raises(ValueError):
        structure.slice_(x, [0, 0, 0], [2, 4, 4])
    with pytest.raises(ValueError):
        structure.reshape(x, (5, 5))
    with pytest.raises(PySparkException):
        collect(structure.gather(x, ref(spark, [3.0]), 1))


def test_reductions(spark):
    a = rng().normal(size=(3, 4, 5))
    x = ref(spark, a)
    for kind, f in {"sum": np.sum, "mean": np.mean, "max": np.max, "min": np.min, "prod": np.prod}.items():
        assert np.allclose(collect(reduce.reduce(x, kind, [0, 2])), f(a, axis=(0, 2)))
        assert np.allclose(collect(reduce.reduce(x, kind, [1], keepdims=True)), f(a, axis=1, keepdims=True))
    b = np.array([[0.0, 1.0], [2.0, 3.0]])
    assert collect(reduce.reduce(ref(spark, b), "all", [1])).tolist() == [0.0, 1.0]
    assert collect(reduce.reduce(ref(spark, b), "any")) == 1.0
    assert np.allclose(collect(reduce.norm(x, 1, 3)), (np.abs(a) ** 3).sum(1, keepdims=True) ** (1 / 3))
    nan = np.array([[np.nan, 2.0], [np.nan, np.nan]])
    assert collect(reduce.reduce(ref(spark, nan), "max", [1])).tolist() == [2.0, -math.inf]


def test_contractions(spark):
    a, b = rng(1).normal(size=(2, 1, 3, 4)), rng(2).normal(size=(2, 5, 4, 2))
    assert np.allclose(collect(contract.matmul(ref(spark, a), ref(spark, b))), a @ b)
    c, d, e = rng(3).normal(size=(3, 4)), rng(4).normal(size=(4, 5)), rng(5).normal(size=(5, 3))
    for eq in ("ij,jk,kl->il", "ij,jk,ki->", "ij,jk,kl->jl"):
        assert np.allclose(collect(contract.einsum(eq, ref(spark, c), ref(spark, d), ref(spark, e))), np.einsum(eq, c, d, e))
    assert np.allclose(collect(contract.matmul(ref(spark, c), ref(spark, d), "kahan")), c @ d)
    with pytest.raises(ValueError):
        contract.einsum("ij,jk", ref(spark, c), ref(spark, d))


def test_windows(spark):
    a = rng().normal(size=(3, 5))
    x = ref(spark, a)
    e = np.exp(a - a.max(0))
    assert np.allclose(collect(windowed.softmax(x, 0)), e / e.sum(0))
    assert np.allclose(collect(windowed.cumsum(x, 1)), a.cumsum(1))
    assert np.array_equal(collect(windowed.sort(x, 0, True)), -np.sort(-a, 0))
    ties = ref(spark, [[1.0, 3.0, 3.0, 0.0]])
    assert collect(windowed.topk(ties, 2)[1]).tolist() == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        windowed.topk(x, 9)
    h, want = 0.0, []
    for v in a[0]:
        h = 0.5 * h + v
        want.append(h)
    assert np.allclose(collect(windowed.scan_sum(x, 0.5))[0], want)


def _attention(q, k, v, keep, scale):
    s = np.einsum("bhid,bhjd->bhij", q, k) * scale
    s = np.where(keep, s, -np.inf)
    with np.errstate(all="ignore"):
        p = np.exp(s - s.max(-1, keepdims=True))
        p = np.nan_to_num(p / p.sum(-1, keepdims=True))
    return p @ v


def test_attention(spark):
    q, k, v = (rng(s).normal(size=(1, h, n, 4)) for s, h, n in ((1, 4, 3), (2, 2, 5), (3, 2, 5)))
    wide = [np.repeat(t, 2, axis=1) for t in (k, v)]
    i, j = np.arange(3)[:, None] + 2, np.arange(5)[None, :]
    keep = (j <= i) & (j > i - 2)
    got = nn.attention(ref(spark, q), ref(spark, k), ref(spark, v), causal=True, window=2, kv_groups=2)
    assert np.allclose(collect(got), _attention(q, *wide, keep, 0.5))
    mask = np.zeros((3, 5))
    mask[1] = -np.inf
    got = collect(nn.attention(ref(spark, q), ref(spark, k), ref(spark, v), ref(spark, mask), kv_groups=2))
    assert np.allclose(got, _attention(q, *wide, mask == 0, 0.5)) and not got[0, :, 1].any()


def test_scan_against_its_recurrence(spark):
    b, p, n, t = 1, 2, 3, 4
    u, dt = rng(1).normal(size=(b, p, t)), np.abs(rng(2).normal(size=(b, p, t)))
    a, bb, cc, d = -np.abs(rng(3).normal(size=(p, n))), rng(4).normal(size=(b, n, t)), rng(5).normal(size=(b, n, t)), rng(6).normal(size=p)
    want = np.zeros((b, p, t))
    h = np.zeros((p, n))
    for k in range(t):
        h = np.exp(dt[0, :, k, None] * a) * h + dt[0, :, k, None] * bb[0, :, k] * u[0, :, k, None]
        want[0, :, k] = h @ cc[0, :, k] + d * u[0, :, k]
    assert np.allclose(collect(nn.ssm_scan(*(ref(spark, x) for x in (u, dt, a, bb, cc, d)))), want)
    with pytest.raises(ValueError):
        nn.ssm_scan(*(ref(spark, x) for x in (u, dt, a.T, bb, cc)))


def test_convolution_groups_and_strides(spark):
    x, w, bias = rng(1).normal(size=(1, 4, 7)), rng(2).normal(size=(2, 2, 3)), rng(3).normal(size=2)
    padded = np.pad(x, [(0, 0), (0, 0), (1, 1)])
    want = np.zeros((1, 2, 3))
    for o in range(2):
        for i in range(3):
            want[0, o, i] = sum(padded[0, 2 * o + c, 2 * i + 2 * k] * w[o, c, k] for c in range(2) for k in range(3)) + bias[o]
    assert np.allclose(collect(nn.conv(ref(spark, x), ref(spark, w), ref(spark, bias), stride=[2], padding=[1], dilation=[2], groups=2)), want)


def test_rope_refuses_odd_depth(spark):
    with pytest.raises(ValueError):
        nn.rope(ref(spark, np.ones((2, 3))))


def test_quantization(spark):
    a = rng().normal(size=(4, 8))
    for formula, q in (("sym", "i8"), ("affine-sub", "u8"), ("affine-add", "u8")):
        scheme = quant.Scheme(formula, q, (1, 4))
        ints, s, z = quant.quantize(ref(spark, a), scheme)
        back = quant.dequantize(ints, scheme, scale=s, zero=None if formula == "sym" else z)
        assert np.abs(collect(back) - a).max() < 0.02
        assert np.allclose(collect(quant.fake_quant(ref(spark, a), scheme)), collect(back))
    with pytest.raises(ValueError):
        quant.dequantize(ints, quant.Scheme("sym", "i8"), scale=s, zero=z)
    with pytest.raises(ValueError):
        quant.Scheme("other")
    book = quant.normal_float(4)
    assert len(book) == 16 and book[0] == -1 and book[-1] == 1 and 0.0 in book
    nearest = collect(quant.codebook_nearest(ref(spark, a / 4), ref(spark, book)))
    assert np.array_equal(nearest, np.abs(np.array(book)[None, None] - (a / 4)[..., None]).argmin(-1))


def test_requantize_prefers_the_cheapest(spark):
    a = rng().normal(size=(2, 16))
    a[0, 0] = 40
    got = {r.blk: r for r in quant.requantize(ref(spark, a), 3, 16, store="f64").collect()}
    for blk in (0, 1):
        costs = []
        for ratio in quant.CLIP_RATIOS:
            s = np.abs(a[blk]).max() * ratio / 3
            costs.append(((np.clip(np.rint(a[blk] / s), -3, 3) * s - a[blk]) ** 2).sum())
        assert got[blk].ratio == quant.CLIP_RATIOS[int(np.argmin(costs))]


def test_sparse_refusals(spark):
    with pytest.raises(PySparkException):
        collect(sparse.coo(ref(spark, [[9.0]]), ref(spark, [1.0]), (3,)))
    with pytest.raises(PySparkException):
        collect(sparse.csr(ref(spark, [0, 2, 1]), ref(spark, [0, 1]), ref(spark, [5, 6]), (2, 2)))
    with pytest.raises(PySparkException):
        collect(sparse.bitmask(ref(spark, [[1, 1]]), ref(spark, [5.0]), (1, 2)))
    with pytest.raises(PySparkException):
        collect(sparse.nm(ref(spark, [[1, 1, 0, 0]]), ref(spark, [5.0, 6.0]), (1, 4), 1, 2))
    with pytest.raises(ValueError):
        sparse.csr(ref(spark, [0, 1]), ref(spark, [0]), ref(spark, [5]), (2, 2))
    dup = sparse.coo(ref(spark, [[0, 0], [1, 1]]), ref(spark, [5.0, 7.0]), (2, 2))
    assert collect(dup).tolist() == [[0, 7], [0, 0]]


def test_merges(spark):
    a, b = np.array([1.0, -4.0, 0.5, 3.0]), np.array([-2.0, -3.0, 0.1, 2.0])
    got = collect(merge.ties([ref(spark, a), ref(spark, b)], 0.75))
    assert np.allclose(got, [-2.0, -3.5, 0.0, 2.5])
    zero = collect(merge.slerp(ref(spark, np.zeros(3)), ref(spark, np.ones(3)), 0.25))
    assert np.allclose(zero, 0.25)
    x = np.ones(2000)
    one, two = (collect(merge.dare([ref(spark, x)], 0.5, seed=s)) for s in (1, 1))
    assert np.array_equal(one, two) and set(one) == {0.0, 2.0} and abs(one.mean() - 1) < 0.1
    with pytest.raises(ValueError):
        merge.method("dora")
