"""Rounding and IEEE helpers against NumPy, over whole value sets where they are small."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.functions import floatsem as S
from tensorloom.functions.dtypes import TYPES, dtype, fixed, round_through


def _apply(spark, values, f):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def _same(a, b):
    return all((math.isnan(x) and math.isnan(y)) or x == y for x, y in zip(a, b, strict=True))


def test_f16_matches_numpy(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-8, 6, 500), [0.0, 65504, 65519, 65520, 1e9, -1e9, 2**-24, 2**-25, 3 * 2**-25, np.inf, -np.inf, np.nan]])
    with np.errstate(over="ignore"):
        want = v.astype(np.float16).astype(float)
    assert _same(_apply(spark, v, lambda c: round_through(c, "f16")), want)


def test_f16_keeps_every_value(spark):
    every = np.arange(0, 1 << 16, 37, dtype=np.uint16).view(np.float16).astype(float)
    every = every[~np.isnan(every)]
    assert _same(_apply(spark, every, lambda c: round_through(c, "f16")), every)


def _values(t):
    out = {0.0}
    for e in range(1 << t.exponent):
        for m in range(1 << t.mantissa):
            out.add(m * 2.0 ** (1 - t.bias - t.mantissa) if e == 0 else (1 + m / (1 << t.mantissa)) * 2.0 ** (e - t.bias))
    return np.array(sorted(x for x in out if x <= t.largest))


@pytest.mark.parametrize("name", ["f8e4m3", "f8e5m2", "f6e3m2", "f6e2m3", "f4e2m1"])
def test_small_floats_round_to_the_nearest_even(spark, name):
    t = dtype(name)
    grid = _values(t)
    mids = (grid[1:] + grid[:-1]) / 2
    probes = np.concatenate([grid, mids, mids * (1 + 1e-9), mids * (1 - 1e-9)])
    probes = probes[probes <= t.largest]

    def nearest(x):
        d = np.abs(grid - x)
        best = np.flatnonzero(d == d.min())
        return grid[best[0]] if len(best) == 1 else grid[[k for k in best if k % 2 == 0][0]]

    assert _same(_apply(spark, probes, lambda c: round_through(c, name)), [nearest(x) for x in probes])


def test_beyond_the_range(spark):
    assert _same(_apply(spark, [500, -500, math.inf, math.nan], lambda c: round_through(c, "f8e4m3")), [448, -448, 448, math.nan])
    assert _same(_apply(spark, [1e9, -math.inf, math.nan], lambda c: round_through(c, "f8e5m2")), [math.inf, -math.inf, math.nan])
    assert _same(_apply(spark, [99, math.nan], lambda c: round_through(c, "f4e2m1")), [6, 6])


def test_scales_are_floored_powers(spark):
    assert _apply(spark, [1, 1.99, 2, 3, 0, 0.3], lambda c: round_through(c, "e8m0")) == [1, 1, 2, 2, 2.0**-127, 0.25]


def test_integers_saturate(spark):
    assert _apply(spark, [2.5, 3.5, 200, -200, math.nan], lambda c: round_through(c, "i8")) == [2, 4, 127, -128, 0]
    assert _apply(spark, [-1, 300, 7.5], lambda c: round_through(c, "u8")) == [0, 255, 8]
    assert _apply(spark, [0.3, 9], lambda c: round_through(c, fixed(4, 2))) == [0.25, 1.75]


def test_directed_and_stochastic(spark):
    v = [1.01, -1.01]
    assert _apply(spark, v, lambda c: round_through(c, "i8", "rup")) == [2, -1]
    assert _apply(spark, v, lambda c: round_through(c, "i8", "rdown")) == [1, -2]
    assert _apply(spark, v, lambda c: round_through(c, "i8", "rtz")) == [1, -1]
    got = [r.o for r in spark.range(4000).select(round_through(F.lit(0.25), "i8", "stochastic", 3, F.col("id")).alias("o")).collect()]
    assert set(got) == {0.0, 1.0} and abs(np.mean(got) - 0.25) < 0.04
    with pytest.raises(ValueError):
        round_through(F.lit(1.0), "i8", "stochastic")


def test_division_and_logarithm(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (math.nan, 0.0), (6.0, 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a double, b double")
    got = [r.o for r in df.select("i", S.fdiv(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]
    assert _same(got, [math.inf, -math.inf, -math.inf, math.nan, math.nan, 2.0])
    assert _same(_apply(spark, [0, -1, math.e], S.fln), [-math.inf, math.nan, 1.0])
    got = [tuple(r) for r in spark.range(1).select(S.fmax(F.lit(math.nan), F.lit(2.0)), S.fmin(F.lit(1.0), F.lit(math.nan))).collect()]
    assert got == [(2.0, 1.0)]


def test_erf(spark):
    v = np.linspace(-7, 7, 281)
    assert np.allclose(_apply(spark, v, S.erf), [math.erf(x) for x in v], atol=1e-13)


def test_kahan(spark):
    values = F.array(*(F.lit(x) for x in [1e16, 1.0, 1.0, -1e16]))
    row = spark.range(1).select(S.kahan_sum(values), S.ordered_sum(values)).first()
    assert row[0] == 2.0 and row[1] != 2.0


def test_packed_sizes():
    assert TYPES["i4"].packed_bytes(3) == 2 and TYPES["ternary"].packed_bytes(6) == 2
