"""IEEE-style arithmetic as Catalyst expressions.

Spark raises on a zero divisor, gives null for the logarithm of zero, and
orders NaN above infinity.  These helpers give what IEEE arithmetic gives.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def lit(x: float) -> Column:
    return F.lit(float(x))


def fdiv(a: Column, b: Column) -> Column:
    """a / b: a zero divisor gives a signed infinity, or NaN for 0 / 0."""
    bad = (a == 0) | F.isnan(a)
    sign = F.signum(a) * F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    return F.when(b != 0, a / b).when(a.isNull() | b.isNull(), None).when(bad, lit(NAN)).otherwise(sign * lit(INF))


def fln(a: Column) -> Column:
    """Natural logarithm: zero gives -Inf, a negative number NaN."""
    return F.when(a == 0, lit(-INF)).when(a < 0, lit(NAN)).otherwise(F.ln(a))


def fmax(a: Column, b: Column) -> Column:
    """The larger one; a NaN operand is ignored."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def fmin(a: Column, b: Column) -> Column:
    """The smaller one; a NaN operand is ignored."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def max_agg(v: Column) -> Column:
    """Maximum without NaN; -Inf where nothing is left."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), lit(-INF))


def min_agg(v: Column) -> Column:
    """Minimum without NaN; Inf where nothing is left."""
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), lit(INF))


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != lit(INF))


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def softplus(v: Column) -> Column:
    """ln(1 + e^v) without overflow."""
    return F.greatest(v, lit(0)) + F.log1p(F.exp(-F.abs(v)))


def erf(v: Column) -> Column:
    """Gauss error function: a series near zero, a continued fraction in the tails."""
    x = F.abs(v)
    square = x * x
    series = lit(0)
    for n in range(34, -1, -1):  # sum of (-1)^n x^2n / (n! (2n+1)), by Horner
        series = lit((-1) ** n / (math.factorial(n) * (2 * n + 1))) + square * series if n < 34 else lit(1 / (math.factorial(n) * (2 * n + 1)))
    near = lit(2 / math.sqrt(math.pi)) * x * series
    tail = x
    for k in range(40, 0, -1):  # Laplace's continued fraction
        tail = x + lit(k / 2) / tail
    far = 1.0 - F.exp(-square) / (lit(math.sqrt(math.pi)) * tail)
    return F.when(F.isnan(v), lit(NAN)).otherwise(F.signum(v) * F.when(x < 2.5, near).when(x > 6, lit(1)).otherwise(far))


def kahan_sum(values: Column) -> Column:
    """Compensated sum of an array of doubles, in its order."""
    start = F.struct(lit(0).alias("s"), lit(0).alias("c"))

    def step(acc: Column, x: Column) -> Column:
        y = x - acc["c"]
        t = acc["s"] + y
        return F.struct(t.alias("s"), ((t - acc["s"]) - y).alias("c"))

    return F.aggregate(values, start, step, lambda acc: acc["s"])


def ordered_sum(values: Column) -> Column:
    """Sum of an array from its first to its last element."""
    return F.aggregate(values, lit(0), lambda acc, x: acc + x)


def _halved(values, low: int, high: int) -> float:
    """The sum of the first half of a range plus that of its second half, and so on down."""
    if high - low < 2:
        return values[low] if high > low else 0.0
    middle = low + (high - low) // 2
    return _halved(values, low, middle) + _halved(values, middle, high)


def pairwise_sum(values: Column) -> Column:
    """Sum of an array by halves, its halves by theirs: the error grows with the logarithm of its length."""

    @F.arrow_udf("double")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else _halved(r, 0, len(r)) for r in rows.to_pylist()], pa.float64())

    return run(values)
