"""Numeric types as descriptors, and rounding of a double through one.

A float type is (exponent bits, mantissa bits, bias, what it does beyond its
range).  Every value of such a type is held as the double it stands for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .floatsem import INF, NAN, lit

ROUNDINGS = ("rne", "rtz", "rup", "rdown", "stochastic")


@dataclass(frozen=True)
class DType:
    """``kind`` is float, int, fixed, bool, binary, ternary, scale, or opaque."""

    name: str
    kind: str
    bits: float
    exponent: int = 0
    mantissa: int = 0
    bias: int = 0
    #: Beyond the range: "inf", "clamp" (NaN stays), or "total" (NaN becomes the maximum).
    beyond: str = "inf"
    signed: bool = True
    fraction: int = 0

    @property
    def least_exponent(self) -> int:
        return 1 - self.bias

    @property
    def largest(self) -> float:
        """The largest finite value."""
        if self.kind == "int":
            return float((1 << (int(self.bits) - self.signed)) - 1)
        if self.kind == "fixed":
            return ((1 << (int(self.bits) - 1)) - 1) / (1 << self.fraction)
        top = (1 << self.exponent) - 1 - self.bias
        if self.beyond == "inf":
            return 2.0 ** (top - 1) * (2 - 2.0**-self.mantissa)
        if self.beyond == "clamp":  # the last pattern is NaN
            return 2.0**top * (2 - 2.0 ** (1 - self.mantissa))
        return 2.0**top * (2 - 2.0**-self.mantissa)

    @property
    def smallest(self) -> float:
        """The lowest value of an integer or fixed type."""
        if self.kind == "int":
            return -float(1 << (int(self.bits) - 1)) if self.signed else 0.0
        return -float(1 << (int(self.bits) - 1)) / (1 << self.fraction)

    def packed_bytes(self, n: int) -> int:
        """Bytes of n packed elements; five ternary digits share a byte."""
        return -(-n // 5) if self.kind == "ternary" else -(-n * int(self.bits) // 8)


def _floats() -> list[DType]:
    rows = (
        ("f64", 11, 52, 1023, "inf"),
        ("f32", 8, 23, 127, "inf"),
        ("f16", 5, 10, 15, "inf"),
        ("bf16", 8, 7, 127, "inf"),
        ("tf32", 8, 10, 127, "inf"),
        ("f8e4m3", 4, 3, 7, "clamp"),
        ("f8e5m2", 5, 2, 15, "inf"),
        ("f6e3m2", 3, 2, 3, "total"),
        ("f6e2m3", 2, 3, 1, "total"),
        ("f4e2m1", 2, 1, 1, "total"),
    )
    return [DType(n, "float", 19 if n == "tf32" else 1 + e + m, e, m, b, beyond) for n, e, m, b, beyond in rows]


TYPES: dict[str, DType] = {t.name: t for t in _floats()}
TYPES["e8m0"] = DType("e8m0", "scale", 8, 8, 0, 127, "total", signed=False)
TYPES |= {f"i{w}": DType(f"i{w}", "int", w) for w in (2, 3, 4, 5, 6, 8, 16, 32, 64)}
TYPES |= {f"u{w}": DType(f"u{w}", "int", w, signed=False) for w in (1, 2, 3, 4, 5, 6, 8, 16, 32, 64)}
TYPES |= {"bool": DType("bool", "bool", 8), "binary": DType("binary", "binary", 1), "ternary": DType("ternary", "ternary", 8 / 5), "opaque": DType("opaque", "opaque", 8)}


def fixed(width: int, fraction: int) -> DType:
    """Q format: ``width`` bits of which ``fraction`` lie behind the point."""
    return DType(f"q{width}.{fraction}", "fixed", width, fraction=fraction)


def dtype(name: str | DType) -> DType:
    if isinstance(name, DType):
        return name
    if name not in TYPES:
        raise ValueError(f"no type {name!r}")
    return TYPES[name]


def wider(a: DType, b: DType) -> DType:
    """The type of a mixed operation: more bits, the left one where equal."""
    return b if b.bits > a.bits else a


def uniform(seed: int, index: Column) -> Column:
    """A number in [0, 1) that depends on seed and index alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), index.cast("long")), 11) * lit(2.0**-53)


def _to_integer(q: Column, mode: str, seed: int, index: Column | None) -> Column:
    match mode:
        case "rne":
            return F.rint(q)
        case "rtz":
            return F.signum(q) * F.floor(F.abs(q)).cast("double")
        case "rup":
            return F.ceil(q).cast("double")
        case "rdown":
            return F.floor(q).cast("double")
        case "stochastic":
            if index is None:
                raise ValueError("stochastic rounding needs an index")
            return F.floor(q + uniform(seed, index)).cast("double")
    raise ValueError(f"no rounding {mode!r}")


def _power_below(a: Column) -> Column:
    """The largest power of two that a positive double is not below; the logarithm's own error is put right."""
    guess = F.pow(lit(2), F.greatest(F.floor(F.log2(a)).cast("double"), lit(-1022)))
    return guess * (lit(1) - (guess > a).cast("double") * 0.5 + (guess * 2 <= a).cast("double"))


def round_through(v: Column, to: str | DType, mode: str = "rne", seed: int = 0, index: Column | None = None) -> Column:
    """The value of ``to`` that a double is stored as."""
    t = dtype(to)
    if mode not in ROUNDINGS:
        raise ValueError(f"no rounding {mode!r}")
    if t.name == "f64":
        return v
    if t.name == "f32" and mode == "rne":
        return v.cast("float").cast("double")
    a = F.abs(v)
    if t.kind in ("int", "fixed"):
        unit = 2.0**t.fraction
        r = _to_integer(v * unit, mode, seed, index) / unit
        return F.when(F.isnan(v), lit(0)).when(v >= t.largest, lit(t.largest)).when(v <= t.smallest, lit(t.smallest)).otherwise(F.least(F.greatest(r, lit(t.smallest)), lit(t.largest)))
    if t.kind == "bool":
        return F.when(v != 0, lit(1)).otherwise(lit(0))
    if t.kind == "binary":
        return F.when(v >= 0, lit(1)).otherwise(lit(-1))
    if t.kind == "ternary":
        return F.when(F.isnan(v), lit(0)).otherwise(F.signum(F.rint(F.least(F.greatest(v, lit(-1)), lit(1)))))
    if t.kind == "scale":  # powers of two only; the exponent is floored
        least, most = 2.0**-127, 2.0**127
        return F.when(F.isnan(v), lit(most)).when(a <= least, lit(least)).when(a >= most, lit(most)).otherwise(_power_below(a))
    if t.kind != "float":
        raise ValueError(f"{t.name} has no encoding of numbers")
    # Arithmetic without branches, so that the logarithm is worked out once a value.
    inside = F.when(finite_nonzero(a), a).otherwise(lit(1))
    unit = F.greatest(_power_below(inside), lit(2.0**t.least_exponent)) * lit(2.0**-t.mantissa)
    r = _to_integer(v / unit, mode, seed, index) * unit
    top = t.largest
    if t.beyond != "inf":
        over = F.signum(v) * lit(top)
    elif mode in ("rne", "stochastic"):
        over = F.signum(v) * lit(INF)
    else:
        away = {"rup": v > 0, "rdown": v < 0}.get(mode, F.lit(False))
        over = F.when((a == lit(INF)) | away, F.signum(v) * lit(INF)).otherwise(F.signum(v) * lit(top))
    nan = lit(top) if t.beyond == "total" else lit(NAN)
    # NaN is larger than any number here.
    return F.when(F.abs(r) > top, F.when(F.isnan(v), nan).otherwise(over)).when(a == 0, v).otherwise(r)


def finite_nonzero(a: Column) -> Column:
    return (a > 0) & (a < lit(INF))
