"""Elementwise operators, with broadcasting by equi-joins on positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..functions.dtypes import DType, dtype, round_through, wider
from ..tensor import TensorRef, position, strides
from .structure import broadcast_to


def broadcast_shape(*shapes: tuple[int, ...]) -> tuple[int, ...]:
    rank = max(map(len, shapes))
    out = []
    for k in range(rank):
        extents = {s[len(s) - rank + k] for s in shapes if len(s) - rank + k >= 0} - {1}
        if len(extents) > 1:
            raise ValueError(f"shapes {shapes} do not broadcast")
        out.append(extents.pop() if extents else 1)
    return tuple(out)


def _source(shape: tuple[int, ...], out: tuple[int, ...], name: str = "pos") -> Column:
    """The position in an operand of ``shape`` of each position of ``out``."""
    pad = (1,) * (len(out) - len(shape)) + shape
    step = strides(pad)
    coords = [F.expr(f"(`{name}` div {s}L) % {n}L") for s, n in zip(strides(out), out, strict=True)]
    return position([c if n > 1 else F.lit(0) for c, n in zip(coords, pad, strict=True)], pad) if step else F.lit(0).cast("long")


def combine(f: Callable[..., Column], *operands: TensorRef, to: DType | None = None) -> TensorRef:
    """f of aligned values.  Operands of one DataFrame stay one projection."""
    shape = broadcast_shape(*(o.shape for o in operands))
    if to is None:
        to = operands[0].dtype
        for o in operands[1:]:
            to = wider(to, o.dtype)
    first = operands[0]
    if all(o.df is first.df and o.shape == shape for o in operands):
        return TensorRef(first.df, shape, f(*(o.v for o in operands)), to)
    # One operand of the full shape carries the rows; the others are looked up.
    lead = next((k for k, o in enumerate(operands) if o.shape == shape), None)
    base = operands[lead] if lead is not None else broadcast_to(first, shape)
    lead = 0 if lead is None else lead
    df = base.cells().withColumnRenamed("v", f"v{lead}")
    for k, o in enumerate(operands):
        if k == lead:
            continue
        cells = o.cells().select(F.col("pos").alias(f"p{k}"), F.col("v").alias(f"v{k}"))
        df = df.withColumn(f"p{k}", _source(o.shape, shape)).join(cells, f"p{k}").drop(f"p{k}")
    return TensorRef(df, shape, f(*(F.col(f"v{k}") for k in range(len(operands)))), to)


def add(a: TensorRef, b: TensorRef) -> TensorRef:
    return combine(lambda x, y: x + y, a, b).rounded()


def sub(a: TensorRef, b: TensorRef) -> TensorRef:
    return combine(lambda x, y: x - y, a, b).rounded()


def mul(a: TensorRef, b: TensorRef) -> TensorRef:
    return combine(lambda x, y: x * y, a, b).rounded()


def div(a: TensorRef, b: TensorRef) -> TensorRef:
    return combine(S.fdiv, a, b).rounded()


def maximum(a: TensorRef, b: TensorRef) -> TensorRef:
    return combine(S.fmax, a, b).rounded()


def minimum(a: TensorRef, b: TensorRef) -> TensorRef:
    return combine(S.fmin, a, b).rounded()


def where(condition: TensorRef, a: TensorRef, b: TensorRef) -> TensorRef:
    """a where the condition is not zero (NaN is not), else b."""
    return combine(lambda c, x, y: F.when(c != 0, x).otherwise(y), condition, a, b, to=wider(a.dtype, b.dtype))


UNARY: dict[str, Callable[[Column], Column]] = {
    "neg": lambda v: -v,
    "exp": F.exp,
    "log": S.fln,
    "sqrt": F.sqrt,
    "rsqrt": lambda v: S.fdiv(S.lit(1), F.sqrt(v)),
    "tanh": F.tanh,
    "sigmoid": S.sigmoid,
    "erf": S.erf,
    "abs": F.abs,
}

#: sqrt(2 / pi), as the tanh form of GELU has it (fixed value).
_GELU = 0.7978845608028654

ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "relu": lambda v: F.when(F.isnan(v), v).otherwise(F.greatest(v, S.lit(0))),
    "gelu": lambda v: 0.5 * v * (1.0 + S.erf(v * (0.5**0.5))),
    "gelu_tanh": lambda v: 0.5 * v * (1.0 + F.tanh(_GELU * (v + 0.044715 * v * v * v))),
    "silu": lambda v: v * S.sigmoid(v),
    "sigmoid": S.sigmoid,
    "tanh": F.tanh,
}
ACTIVATIONS["gelu_new"], ACTIVATIONS["swish"] = ACTIVATIONS["gelu_tanh"], ACTIVATIONS["silu"]


def unary(kind: str, x: TensorRef) -> TensorRef:
    if kind not in UNARY:
        raise ValueError(f"no elementwise operator {kind!r}")
    return x.map(UNARY[kind]).rounded()


def activation(kind: str, x: TensorRef, gate: TensorRef | None = None) -> TensorRef:
    """An activation, multiplied by a gate where one is given."""
    if kind not in ACTIVATIONS:
        raise ValueError(f"no activation {kind!r}")
    out = x.map(ACTIVATIONS[kind])
    return (out if gate is None else combine(lambda a, b: a * b, out, gate)).rounded()


def scale(x: TensorRef, k) -> TensorRef:
    """x * k for an exact rational k."""
    return x.map(lambda v: v * S.lit(float(k))).rounded()


def clamp(x: TensorRef, low: float, high: float) -> TensorRef:
    """Values between low and high; NaN passes."""
    if low > high:
        raise ValueError(f"clamp from {low} to {high}")
    return x.map(lambda v: F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, S.lit(low)), S.lit(high)))).rounded()


def cast(x: TensorRef, to: str | DType, mode: str = "rne", seed: int = 0) -> TensorRef:
    """Values as the target type stores them."""
    t = dtype(to)
    return x.map(lambda v: round_through(v, t, mode, seed, F.col("pos") if mode == "stochastic" else None), t)


def approx(x: TensorRef, bound: float, kind: str = "abs") -> TensorRef:
    """Marks a value as approximate; the value is unchanged."""
    if kind not in ("abs", "rel", "psnr"):
        raise ValueError(f"no bound {kind!r}")
    return x


def xor(base: TensorRef, patch: TensorRef) -> TensorRef:
    """Bitwise exclusive or of integer values."""
    if base.dtype.kind != "int" or patch.dtype.kind != "int":
        raise ValueError("xor is defined on integer types")
    return combine(lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")).cast("double"), base, patch)
