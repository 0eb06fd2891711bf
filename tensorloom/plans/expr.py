"""Tensor expressions: a typed, normalised tree that becomes one lazy plan.

A tree is built and checked on the driver.  ``normalize`` brings equal
expressions to equal form, ``identity`` names that form, ``deps`` says which
ranges a partial read needs, and ``lower`` makes the DataFrame.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chacha import random_tensor
from ..functions.dtypes import DType, dtype, wider
from ..operators import contract, delta, elementwise, quant, reduce, sparse, structure
from ..tensor import TensorRef, arange, eye, from_cells, full, size, strides

MAX_DEPTH = 256


class TypeFault(ValueError):
    """An expression that has no type."""


@dataclass(frozen=True)
class Type:
    shape: tuple[int, ...]
    dtype: DType


@dataclass(frozen=True)
class Expr:
    """A node: its name, operands, and plain attributes."""

    op: str
    args: tuple[Expr, ...] = ()
    attrs: tuple[tuple[str, Any], ...] = ()

    def __getitem__(self, name: str) -> Any:
        return dict(self.attrs)[name]

    def get(self, name: str, default: Any = None) -> Any:
        return dict(self.attrs).get(name, default)


def node(op: str, *args: Expr, **attrs: Any) -> Expr:
    """A node by name; ``transpose``, ``zeros`` and ``ones`` are written out."""
    if op in ("zeros", "ones"):
        return node("full", value=float(op == "ones"), **attrs)
    if op == "transpose":
        rank = len(infer(args[0]).shape)
        if rank < 2:
            raise TypeFault("transpose needs two axes")
        return node("permute", *args, perm=[*range(rank - 2), rank - 1, rank - 2])
    if op not in NODES:
        raise TypeFault(f"no node {op!r}")
    return Expr(op, tuple(args), tuple(sorted((k, _frozen(v)) for k, v in attrs.items() if v is not None)))


def _frozen(v: Any) -> Any:
    if isinstance(v, dict):
        return tuple(sorted((k, _frozen(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_frozen(x) for x in v)
    return v


#: Nodes that work on values one by one, and keep the shape of their operand.
_POINTWISE = ("scale", "clamp", "cast", "approx", "relayout")
_BINARY = ("add", "sub", "mul", "div")
NODES = (
    "literal", "extern", "full", "arange", "eye", "random",
    "reshape", "permute", "squeeze", "expand", "slice", "concat", "split", "pad", "gather", "relayout",
    "cast", "add", "sub", "mul", "div", "scale", "matmul", "norm", "clamp",
    "dequantize", "quantize", "sparse", "approx", "delta", "select", "plugin",
)


def infer(e: Expr, depth: int = 0) -> Type:
    """The type of an expression, or a fault that says why there is none."""
    if depth > MAX_DEPTH:
        raise TypeFault(f"deeper than {MAX_DEPTH}")
    t = [infer(a, depth + 1) for a in e.args if a.op != "none"]
    x = t[0] if t else None
    shape = x.shape if x else ()

    def need(ok: bool, why: str) -> None:
        if not ok:
            raise TypeFault(f"{e.op}: {why}")

    match e.op:
        case "literal" | "extern" | "full" | "random":
            return Type(tuple(e["shape"]), dtype(e.get("dtype", "f64")))
        case "arange":
            return Type((e["n"],), dtype(e.get("dtype", "f64")))
        case "eye":
            return Type((e["rows"], e.get("columns") or e["rows"]), dtype(e.get("dtype", "f64")))
        case "reshape":
            need(size(e["shape"]) == size(shape), f"{shape} has not the elements of {e['shape']}")
            return Type(tuple(e["shape"]), x.dtype)
        case "permute":
            need(sorted(e["perm"]) == list(range(len(shape))), "no permutation")
            return Type(tuple(shape[p] for p in e["perm"]), x.dtype)
        case "squeeze":
            axes = {a % len(shape) for a in e["axes"]}
            need(all(shape[a] == 1 for a in axes), "an axis is not one")
            return Type(tuple(n for k, n in enumerate(shape) if k not in axes), x.dtype)
        case "expand":
            pad = (1,) * (len(e["shape"]) - len(shape)) + shape
            need(len(pad) == len(e["shape"]) and all(a in (1, b) for a, b in zip(pad, e["shape"], strict=True)), "does not broadcast")
            return Type(tuple(e["shape"]), x.dtype)
        case "slice":
            out = []
            for n, a, m, s in zip(shape, e["starts"], e["sizes"], e.get("steps") or (1,) * len(shape), strict=True):
                need(a >= 0 and s >= 1 and m >= 0 and (m == 0 or a + (m - 1) * s < n), "out of range")
                out.append(m)
            return Type(tuple(out), x.dtype)
        case "concat":
            axis = e["axis"] % len(shape)
            need(all(y.dtype == x.dtype and len(y.shape) == len(shape) for y in t), "types or ranks differ")
            need(all(a == b for y in t for k, (a, b) in enumerate(zip(y.shape, shape, strict=True)) if k != axis), "extents differ")
            return Type(tuple(sum(y.shape[axis] for y in t) if k == axis else n for k, n in enumerate(shape)), x.dtype)
        case "split":
            axis = e["axis"] % len(shape)
            need(sum(e["sizes"]) == shape[axis] and 0 <= e["pick"] < len(e["sizes"]), "pieces do not fit")
            return Type(tuple(e["sizes"][e["pick"]] if k == axis else n for k, n in enumerate(shape)), x.dtype)
        case "pad":
            need(e.get("mode", "constant") in structure.PAD_MODES, "no such mode")
            return Type(tuple(a + n + b for n, (a, b) in zip(shape, e["pads"], strict=True)), x.dtype)
        case "gather":
            need(len(t[1].shape) == 1, "the index has one axis")
            axis = e.get("axis", 0) % len(shape)
            return Type((*shape[:axis], t[1].shape[0], *shape[axis + 1 :]), x.dtype)
        case "cast":
            return Type(shape, dtype(e["dtype"]))
        case "add" | "sub" | "mul" | "div":
            try:
                return Type(elementwise.broadcast_shape(shape, t[1].shape), wider(x.dtype, t[1].dtype))
            except ValueError as why:
                raise TypeFault(str(why)) from None
        case "scale" | "clamp" | "approx" | "relayout":
            return x
        case "matmul":
            a, b = shape, t[1].shape
            need(len(a) >= 2 and len(b) >= 2 and a[-1] == b[-2], f"{a} by {b}")
            batch = elementwise.broadcast_shape(a[:-2] or (1,), b[:-2] or (1,)) if len(a) > 2 or len(b) > 2 else ()
            return Type((*batch, a[-2], b[-1]), wider(x.dtype, t[1].dtype))
        case "norm":
            axis = e["axis"] % len(shape)
            return Type(tuple(1 if k == axis else n for k, n in enumerate(shape)), x.dtype)
        case "quantize":
            return Type(shape, dtype(_scheme(e).q))
        case "dequantize":
            return Type(shape, dtype(_scheme(e).out))
        case "sparse":
            need(e["scheme"] in sparse.SCHEMES, "no such scheme")
            return Type(tuple(e["shape"]), t[-1].dtype)
        case "delta":
            need(e["kind"] in ("add", "sparse-add", "replace", "xor"), "no such kind")
            need(t[1].shape == shape, "patch and base differ in shape")
            return x
        case "select":
            need(t[0] == t[1], "branches differ in type")
            return x
        case "plugin":
            return Type(tuple(e["shape"]), dtype(e.get("dtype", "f64")))
    raise TypeFault(f"no node {e.op!r}")


def check_declared(e: Expr, shape: tuple[int, ...], to: str) -> tuple[str, str]:
    """(status, note): whether a declared type is the inferred one."""
    try:
        got = infer(e)
    except TypeFault as why:
        return "invalid", str(why)
    if got.shape != tuple(shape) or got.dtype.name != to:
        return "invalid", f"declared {tuple(shape)} {to}, inferred {got.shape} {got.dtype.name}"
    return "valid", ""


def _scheme(e: Expr) -> quant.Scheme:
    return quant.Scheme(**dict(e["scheme"]))


# -- normal form ------------------------------------------------------------------------


def _plain(v: Any) -> Any:
    if isinstance(v, Fraction):
        return {"n": v.numerator, "d": v.denominator}
    if isinstance(v, float):
        return {"f": v.hex()}
    if isinstance(v, tuple):
        return [_plain(x) for x in v]
    return v


def encode(e: Expr) -> list:
    return [e.op, {k: _plain(v) for k, v in e.attrs}, [encode(a) for a in e.args]]


def normalize(e: Expr) -> Expr:
    """Fold scales and permutations, drop what does nothing, order commuting operands."""
    e = Expr(e.op, tuple(normalize(a) for a in e.args), e.attrs)
    x = e.args[0] if e.args else None
    match e.op:
        case "scale":
            k = Fraction(e["k"])
            if x.op == "scale":
                k, x = k * Fraction(x["k"]), x.args[0]
            return x if k == 1 else Expr("scale", (x,), (("k", k),))
        case "permute":
            perm = e["perm"]
            if x.op == "permute":
                perm, x = tuple(x["perm"][p] for p in perm), x.args[0]
            return x if list(perm) == list(range(len(perm))) else Expr("permute", (x,), (("perm", tuple(perm)),))
        case "cast" if x.op == "cast" and x["dtype"] == e["dtype"]:
            return x
        case "reshape" | "expand" if x.op == "full":
            return Expr("full", (), tuple(sorted({**dict(x.attrs), "shape": tuple(e["shape"])}.items())))
        case "reshape" if x.op == "reshape":
            return Expr("reshape", x.args, e.attrs)
        case "add" | "mul":
            a, b = sorted(e.args, key=lambda y: json.dumps(encode(y), sort_keys=True))
            if infer(a).dtype.bits == infer(b).dtype.bits and infer(a).dtype != infer(b).dtype:
                return e  # the left type wins, so the order matters
            return Expr(e.op, (a, b), e.attrs)
    return e


def identity(e: Expr) -> str:
    """The digest of the normal form."""
    text = json.dumps(encode(normalize(e)), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(b"tensor expression\0" + text.encode()).hexdigest()


def walk(e: Expr):
    yield e
    for a in e.args:
        yield from walk(a)


def deterministic(e: Expr) -> bool:
    return not any(n.op in ("extern", "plugin") for n in walk(e))


def is_lossy(e: Expr) -> bool:
    return any(n.op in ("approx", "quantize") for n in walk(e))


def required_plugins(e: Expr) -> set[tuple[str, str, int]]:
    return {(n["ns"], n["name"], n.get("version", 1)) for n in walk(e) if n.op == "plugin" and len(n.args) == n.get("operands", len(n.args))}


def with_fallbacks(e: Expr, known: set[tuple[str, str, int]]) -> Expr:
    """Replace plugins that are not known by their fallback, which is their last operand."""
    args = tuple(with_fallbacks(a, known) for a in e.args)
    if e.op == "plugin" and (e["ns"], e["name"], e.get("version", 1)) not in known and e.get("fallback"):
        return args[-1]
    return Expr(e.op, args, e.attrs)


# -- what a partial read needs ---------------------------------------------------------------


@dataclass(frozen=True)
class Dep:
    source: str
    low: int
    high: int
    exact: bool
    reason: str = ""


def deps(e: Expr, low: int = 0, high: int | None = None) -> list[Dep]:
    """Ranges of the sources that cells low..high need; one range a source."""
    high = size(infer(e).shape) if high is None else high
    found: dict[str, Dep] = {}

    def go(e: Expr, low: int, high: int, exact: bool, why: str) -> None:
        def whole(a: Expr, reason: str) -> None:
            n = size(infer(a).shape)
            go(a, 0, n, exact and (low, high) == (0, size(infer(e).shape)), why or reason)

        match e.op:
            case "literal":
                d = found.get(e["source"])
                new = Dep(e["source"], low, high, exact, why)
                found[e["source"]] = new if d is None else Dep(d.source, min(low, d.low), max(high, d.high), exact and d.exact, why or d.reason)
            case "reshape" | "squeeze" | "relayout" | "cast" | "scale" | "clamp" | "approx":
                go(e.args[0], low, high, exact, why)
            case "add" | "sub" | "mul" | "div":
                n = size(infer(e).shape)
                for a in e.args:
                    if size(infer(a).shape) == n:
                        go(a, low, high, exact, why)
                    else:
                        whole(a, "a broadcast operand is read whole")
            case "slice":
                t, steps = infer(e.args[0]), e.get("steps")
                rest = all(a == 0 and m == n for a, m, n in list(zip(e["starts"], e["sizes"], t.shape, strict=True))[1:])
                if rest and (not steps or all(s == 1 for s in steps)):
                    offset = e["starts"][0] * size(t.shape[1:]) if t.shape else 0
                    go(e.args[0], low + offset, high + offset, exact, why)
                else:
                    whole(e.args[0], "a slice of inner axes")
            case "concat" if e["axis"] == 0:
                at = 0
                for a in e.args:
                    n = size(infer(a).shape)
                    if low < at + n and high > at:
                        go(a, max(0, low - at), min(n, high - at), exact, why)
                    at += n
            case "quantize" | "dequantize" if _scheme(e).block and len(infer(e).shape) == len(_scheme(e).block):
                shape, block = infer(e).shape, _scheme(e).block
                row = strides(shape)[0] * block[0] if len(shape) > 1 else block[0]
                go(e.args[0], low // row * row, min(size(shape), -(-high // row) * row), exact and low % row == 0 and high % row == 0, why or "widened to whole blocks")
                for a in e.args[1:]:
                    whole(a, "block parameters")
            case _:
                for a in e.args:
                    whole(a, f"{e.op} reads its operand whole")

    go(e, low, high, True, "")
    return sorted(found.values(), key=lambda d: d.source)


# -- plans --------------------------------------------------------------------------------------


@dataclass
class Context:
    """Where values come from: stored cells, plugins, features, and kept results."""

    spark: SparkSession
    catalog: dict[str, DataFrame] = field(default_factory=dict)
    plugins: dict[tuple[str, str, int], Callable[..., TensorRef]] = field(default_factory=dict)
    features: set[str] = field(default_factory=set)
    kept: dict[str, TensorRef] = field(default_factory=dict)
    most_kept: int = 32
    #: Bytes of cells that are kept at most, sixteen each.
    most_bytes: int = 1 << 34

    def keep(self, e: Expr) -> TensorRef:
        """The plan of an expression, persisted under its identity; what was not used for longest goes first.

        A result larger than the whole bound is given out but not kept.
        """
        key = identity(e)
        if key in self.kept:
            self.kept[key] = self.kept.pop(key)  # the latest
            return self.kept[key]
        t = lower(e, self)
        need = 16 * size(t.shape)
        if need > self.most_bytes:
            return t
        while self.kept and (len(self.kept) >= self.most_kept or need + sum(16 * size(x.shape) for x in self.kept.values()) > self.most_bytes):
            self.kept.pop(next(iter(self.kept))).df.unpersist()
        self.kept[key] = t.with_cells(t.cells().persist())
        return self.kept[key]


def flatten(e: Expr, parents: dict[str, Expr], depth: int) -> Expr:
    """The expression with references to parents put in place, ``depth`` links deep; it denotes the same value.

    ``parents`` maps the name of a source to the expression that it stands for.
    """
    if e.op == "literal" and depth > 0 and e["source"] in parents:
        return flatten(parents[e["source"]], parents, depth - 1)
    return Expr(e.op, tuple(flatten(a, parents, depth) for a in e.args), e.attrs)


def lower(e: Expr, ctx: Context) -> TensorRef:
    """The lazy tensor of an expression.

    Equal subtrees become one plan object, so elementwise chains over one
    source stay one projection.
    """
    infer(e)
    memo: dict[Expr, TensorRef] = {}

    def go(e: Expr) -> TensorRef:
        if e not in memo:
            memo[e] = _lower(e, [go(a) for a in e.args] if e.op not in ("select", "plugin") else [], ctx, go)
        return memo[e]

    return go(e)


def _lower(e: Expr, x: list[TensorRef], ctx: Context, go: Callable[[Expr], TensorRef]) -> TensorRef:
    spark = ctx.spark
    match e.op:
        case "literal":
            if e["source"] not in ctx.catalog:
                raise KeyError(f"no source {e['source']!r}")
            return from_cells(ctx.catalog[e["source"]], e["shape"], e.get("dtype", "f64"))
        case "extern":
            raise PermissionError(f"{e['uri']!r} is not fetched implicitly")
        case "full":
            return full(spark, e["shape"], float(e["value"]), e.get("dtype", "f64"))
        case "arange":
            return arange(spark, e["n"], float(e.get("start", 0)), float(e.get("step", 1)), e.get("dtype", "f64"))
        case "eye":
            return eye(spark, e["rows"], e.get("columns"), e.get("dtype", "f64"))
        case "random":
            return random_tensor(spark, e["shape"], e["seed"], e.get("kind", "uniform"), e.get("low", 0.0), e.get("high", 1.0), e.get("dtype", "f64"))
        case "reshape":
            return structure.reshape(x[0], e["shape"])
        case "permute":
            return structure.permute(x[0], e["perm"])
        case "squeeze":
            return structure.squeeze(x[0], e["axes"])
        case "expand":
            return structure.broadcast_to(x[0], e["shape"])
        case "slice":
            steps = e.get("steps") or (1,) * x[0].rank
            return structure.slice_(x[0], e["starts"], [a + (m - 1) * s + 1 if m else a for a, m, s in zip(e["starts"], e["sizes"], steps, strict=True)], steps)
        case "concat":
            return structure.concat(x, e["axis"])
        case "split":
            return structure.split(x[0], e["axis"], e["sizes"], e["pick"])
        case "pad":
            return structure.pad(x[0], [p[0] for p in e["pads"]], [p[1] for p in e["pads"]], e.get("mode", "constant"), e.get("value", 0.0))
        case "gather":
            return structure.gather(x[0], x[1], e.get("axis", 0))
        case "relayout" | "approx":
            return x[0]
        case "cast":
            return elementwise.cast(x[0], e["dtype"], e.get("round", "rne"), e.get("seed", 0))
        case "add" | "sub" | "mul" | "div":
            return {"add": elementwise.add, "sub": elementwise.sub, "mul": elementwise.mul, "div": elementwise.div}[e.op](*x)
        case "scale":
            return elementwise.scale(x[0], Fraction(e["k"]))
        case "matmul":
            return contract.matmul(*x, order=e.get("sum", "unspecified"))
        case "norm":
            return reduce.norm(x[0], e["axis"], e.get("p", 2))
        case "clamp":
            return elementwise.clamp(x[0], e["lo"], e["hi"])
        case "quantize":
            return quant.quantize(x[0], _scheme(e), **dict(zip(e.get("parts", ()), x[1:], strict=True)))[0]
        case "dequantize":
            return quant.dequantize(x[0], _scheme(e), **dict(zip(e.get("parts", ()), x[1:], strict=True)))
        case "sparse":
            options = {k: e[k] for k in ("block", "n", "m") if e.get(k)}
            return getattr(sparse, e["scheme"])(*x, shape=e["shape"], fill=e.get("fill", 0.0), **options)
        case "delta":
            return delta.apply(x[0], x[1], e["kind"])
        case "select":
            return go(e.args[0] if e["feature"] in ctx.features else e.args[1])
        case "plugin":
            host = ctx.plugins.get((e["ns"], e["name"], e.get("version", 1)))
            if host:
                own = e.args[:-1] if e.get("fallback") else e.args
                return host(*(go(a) for a in own), **dict(e.get("options", ())))
            if e.get("fallback"):
                return go(e.args[-1])
            raise NotImplementedError(f"no plugin {e['ns']}/{e['name']}")
    raise TypeFault(f"no node {e.op!r}")


def evaluate(e: Expr, ctx: Context, low: int | None = None, high: int | None = None) -> DataFrame:
    """Cells of an expression, or of a range; sources are read by the ranges of ``deps``."""
    if low is None:
        return lower(e, ctx).cells()
    high = size(infer(e).shape) if high is None else high
    cut = {d.source: ctx.catalog[d.source].where((F.col("pos") >= d.low) & (F.col("pos") < d.high)) for d in deps(e, low, high)}
    own = Context(ctx.spark, {**ctx.catalog, **cut}, ctx.plugins, ctx.features)
    return lower(e, own).cells().where((F.col("pos") >= low) & (F.col("pos") < high))
