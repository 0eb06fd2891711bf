"""ONNX models as graph modules, by a reader and writer of the wire format.

Operations with a counterpart become it; the rest keep their names in a
dialect of their own, which a caller may give semantics to.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np

from ..plans.graph import Function, Module, Op

# -- wire format -----------------------------------------------------------------------


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = raw[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def fields(raw: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of a message; numbers as they stand, the rest as bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", raw, at)[0], at + 8
        elif kind == 5:
            value, at = struct.unpack_from("<f", raw, at)[0], at + 4
        elif kind == 2:
            n, at = _varint(raw, at)
            if at + n > len(raw):
                raise ValueError("a field leaves its message")
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ints(values: list) -> list[int]:
    """Repeated integers, packed or not."""
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(_signed(v))
        else:
            at = 0
            while at < len(v):
                x, at = _varint(v, at)
                out.append(_signed(x))
    return out


def _floats(values: list) -> list[float]:
    out: list[float] = []
    for v in values:
        out += [v] if isinstance(v, float) else np.frombuffer(v, "<f4").tolist()
    return out


def _message(raw: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in fields(raw):
        out.setdefault(number, []).append(value)
    return out


#: Element types and how their raw bytes read (fixed values).
_TYPES = {1: ("f32", "<f4"), 2: ("u8", "u1"), 3: ("i8", "i1"), 5: ("i16", "<i2"), 6: ("i32", "<i4"), 7: ("i64", "<i8"), 9: ("bool", "?"), 10: ("f16", "<f2"), 11: ("f64", "<f8")}


def tensor(raw: bytes) -> tuple[str, np.ndarray]:
    m = _message(raw)
    shape = _ints(m.get(1, []))
    code = m.get(2, [1])[0]
    if code not in _TYPES:
        raise ValueError(f"element type {code}")
    name = m.get(8, [b""])[0].decode()
    if 9 in m:
        a = np.frombuffer(m[9][0], _TYPES[code][1]).astype(float)
    elif code == 1:
        a = np.array(_floats(m.get(4, [])))
    elif code == 11:
        a = np.concatenate([np.frombuffer(v, "<f8") if isinstance(v, bytes) else [v] for v in m.get(10, [b""])])
    else:
        a = np.array(_ints(m.get(7 if code == 7 else 5, [])), dtype=float)
    return name, a.reshape(shape)


def _attribute(raw: bytes) -> tuple[str, Any]:
    m = _message(raw)
    name = m[1][0].decode()
    kind = m.get(20, [0])[0]
    match kind:
        case 1:
            return name, m.get(2, [0.0])[0]
        case 2:
            return name, _signed(m.get(3, [0])[0])
        case 3:
            return name, m.get(4, [b""])[0].decode()
        case 4:
            return name, tensor(m[5][0])[1]
        case 6:
            return name, _floats(m.get(7, []))
        case 7:
            return name, _ints(m.get(8, []))
        case 8:
            return name, [s.decode() for s in m.get(9, [])]
    raise ValueError(f"attribute {name} of kind {kind}")


# -- operations ----------------------------------------------------------------------------

#: Operations that stand for one another without attributes (fixed values).
ONE_TO_ONE = {"Add": "add", "Sub": "sub", "Mul": "mul", "Div": "div", "Neg": "neg", "Exp": "exp", "Log": "log", "Sqrt": "sqrt", "Tanh": "tanh", "Sigmoid": "sigmoid", "Erf": "erf", "MatMul": "matmul", "Where": "where"}
REDUCTIONS = {"ReduceSum": "sum", "ReduceMean": "mean", "ReduceProd": "prod", "ReduceMax": "max", "ReduceMin": "min"}
_CASTS = {code: name for code, (name, _) in _TYPES.items()}


def _convert(kind: str, ins: list[str], outs: tuple[str, ...], a: dict[str, Any], known: dict[str, np.ndarray]) -> list[Op]:
    def constant(k: int) -> list[int] | None:
        return [int(v) for v in known[ins[k]].ravel()] if k < len(ins) and ins[k] in known else None

    if kind in ONE_TO_ONE:
        return [Op(f"tensor.{ONE_TO_ONE[kind]}", tuple(ins), outs)]
    if kind in ("Max", "Min") and len(ins) == 2:
        return [Op("tensor.maximum" if kind == "Max" else "tensor.minimum", tuple(ins), outs)]
    if kind in REDUCTIONS and (axes := a.get("axes") or constant(1)) is not None:
        return [Op("tensor.reduce", (ins[0],), outs, {"kind": REDUCTIONS[kind], "axes": axes, "keepdims": bool(a.get("keepdims", 1))})]
    match kind:
        case "Relu":
            return [Op("nn.activation", (ins[0],), outs, {"kind": "relu"})]
        case "Softmax":
            return [Op("tensor.softmax", (ins[0],), outs, {"axis": a.get("axis", -1)})]
        case "Transpose" if "perm" in a:
            return [Op("tensor.transpose", (ins[0],), outs, {"perm": a["perm"]})]
        case "Concat":
            return [Op("tensor.concat", tuple(ins), outs, {"axis": a["axis"]})]
        case "Gather":
            return [Op("tensor.gather", tuple(ins), outs, {"axis": a.get("axis", 0)})]
        case "Cast" if a["to"] in _CASTS:
            return [Op("tensor.cast", (ins[0],), outs, {"dtype": _CASTS[a["to"]], "round": "rtz" if _CASTS[a["to"]][0] in "iu" else "rne"})]
        case "Reshape" if (shape := constant(1)) is not None and 0 not in shape:
            return [Op("tensor.reshape", (ins[0],), outs, {"shape": shape})]
        case "Expand" if (shape := constant(1)) is not None:
            return [Op("tensor.broadcast", (ins[0],), outs, {"shape": shape})]
        case "Gemm" if a.get("alpha", 1.0) == 1.0 and a.get("beta", 1.0) == 1.0 and not a.get("transA"):
            steps, right = [], ins[1]
            if a.get("transB"):
                right = f"{outs[0]}.t"
                steps.append(Op("tensor.transpose", (ins[1],), (right,), {"perm": [1, 0]}))
            product = outs[0] if len(ins) < 3 else f"{outs[0]}.p"
            steps.append(Op("tensor.matmul", (ins[0], right), (product,)))
            return steps + ([Op("tensor.add", (product, ins[2]), outs)] if len(ins) > 2 else [])
        case "Conv" if not any(a.get("pads", [])[k] != a["pads"][k + len(a["pads"]) // 2] for k in range(len(a.get("pads", [])) // 2)):
            pads = a.get("pads")
            attrs = {"stride": a.get("strides"), "padding": pads[: len(pads) // 2] if pads else None, "dilation": a.get("dilations"), "groups": a.get("group", 1)}
            return [Op("nn.conv", tuple(ins), outs, {k: v for k, v in attrs.items() if v is not None})]
    return [Op(f"onnx.{kind}", tuple(ins), outs, a)]


def read(raw: bytes) -> tuple[Module, dict[str, np.ndarray], list[tuple[str, str]]]:
    """The module, its weights, and a fidelity report of (field, status)."""
    model = _message(raw)
    graph = _message(model[7][0])
    weights = dict(tensor(t) for t in graph.get(5, []))
    name = lambda v: _message(v)[1][0].decode()
    params = [n for n in map(name, graph.get(11, [])) if n not in weights]
    nodes, known = [], dict(weights)
    alias: dict[str, str] = {}
    body: list[Op] = []
    for node in graph.get(1, []):
        m = _message(node)
        ins = [alias.get(s.decode(), s.decode()) for s in m.get(1, [])]
        outs = tuple(s.decode() for s in m.get(2, []))
        kind, attrs = m[4][0].decode(), dict(_attribute(x) for x in m.get(5, []))
        if kind == "Identity":
            alias[outs[0]] = ins[0]
        elif kind == "Constant" and isinstance(attrs.get("value"), np.ndarray):
            known[outs[0]] = weights[outs[0]] = attrs["value"]
        else:
            body += _convert(kind, [i for i in ins if i], outs, attrs, known)
            nodes.append((kind, outs))
    used = {i for op in body for i in op.inputs}
    loads = [Op("core.constant", (), (n,), {"tensor": n}) for n in sorted(weights) if n in used]
    results = tuple(alias.get(n, n) for n in map(name, graph.get(12, [])))
    dialects = {"core": 1, "tensor": 1, "nn": 2, "quant": 1, "io": 1, "onnx": 1}
    module = Module({"main": Function("main", tuple(params), (*loads, *body, Op("core.return", results)))}, dialects=dialects)
    report = [("graph", "preserved"), ("weights", "preserved"), ("documentation", "dropped")] + [(f"node {op.name}", "assumed") for op in body if op.name.startswith("onnx.")]
    return module, weights, report


# -- writing -----------------------------------------------------------------------------------


def _put(number: int, value: Any) -> bytes:
    def var(x: int) -> bytes:
        x &= (1 << 64) - 1
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, (bool, int)):
        return var(number << 3) + var(int(value))
    if isinstance(value, float):
        return var(number << 3 | 5) + struct.pack("<f", value)
    body = value.encode() if isinstance(value, str) else value
    return var(number << 3 | 2) + var(len(body)) + body


def _put_tensor(name: str, a: np.ndarray, code: int = 1) -> bytes:
    return b"".join(_put(1, int(n)) for n in a.shape) + _put(2, code) + _put(8, name) + _put(9, a.astype(_TYPES[code][1]).tobytes())


def _put_attribute(name: str, v: Any) -> bytes:
    head = _put(1, name)
    if isinstance(v, (bool, int)):
        return head + _put(3, int(v)) + _put(20, 2)
    if isinstance(v, float):
        return head + _put(2, v) + _put(20, 1)
    if isinstance(v, str):
        return head + _put(4, v) + _put(20, 3)
    return head + b"".join(_put(8, int(x)) for x in v) + _put(20, 7)


def write(module: Module, weights: dict[str, np.ndarray], name: str = "graph") -> bytes:
    """A model of the operations that map back one to one; others are refused by name."""
    back = {f"tensor.{v}": k for k, v in ONE_TO_ONE.items()} | {"tensor.maximum": "Max", "tensor.minimum": "Min"}
    f = module.functions[module.entry]
    body, outputs, extra = b"", (), {}
    for op in f.body:
        if op.name == "core.constant":
            continue
        if op.name == "core.return":
            outputs = op.inputs
            continue
        ins, attrs = list(op.inputs), {}
        match op.name:
            case "tensor.softmax":
                kind, attrs = "Softmax", {"axis": op.attrs.get("axis", -1)}
            case "tensor.transpose":
                kind, attrs = "Transpose", {"perm": op.attrs["perm"]}
            case "tensor.concat":
                kind, attrs = "Concat", {"axis": op.attrs["axis"]}
            case "tensor.gather":
                kind, attrs = "Gather", {"axis": op.attrs.get("axis", 0)}
            case "nn.activation" if op.attrs["kind"] in ("relu", "sigmoid", "tanh") and len(ins) == 1:
                kind = op.attrs["kind"].capitalize()
            case "tensor.reshape":
                kind = "Reshape"
                extra[f"{op.results[0]}.shape"] = np.array(op.attrs["shape"])
                ins.append(f"{op.results[0]}.shape")
            case "tensor.reduce" if op.attrs["kind"] in REDUCTIONS.values():
                kind = next(k for k, v in REDUCTIONS.items() if v == op.attrs["kind"])
                attrs = {"axes": op.attrs["axes"], "keepdims": int(op.attrs.get("keepdims", False))}
            case _ if op.name in back:
                kind = back[op.name]
            case _:
                raise ValueError(f"{op.name} has no counterpart")
        node = b"".join(_put(1, i) for i in ins) + b"".join(_put(2, o) for o in op.results) + _put(4, kind)
        body += _put(1, node + b"".join(_put(5, _put_attribute(k, v)) for k, v in attrs.items()))
    graph = body + _put(2, name)
    graph += b"".join(_put(5, _put_tensor(n, a)) for n, a in sorted(weights.items())) + b"".join(_put(5, _put_tensor(n, a, 7)) for n, a in sorted(extra.items()))
    graph += b"".join(_put(11, _put(1, p)) for p in f.params) + b"".join(_put(12, _put(1, o)) for o in outputs)
    return _put(1, 8) + _put(7, graph) + _put(8, _put(2, 13))
