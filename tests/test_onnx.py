import numpy as np
import pytest

from tensorloom.plans import graph as G
from tensorloom.sources import onnx
from tensorloom.tensor import collect, literal


def test_round_trip_runs_alike(spark):
    rng = np.random.default_rng(0)
    w = {"w": rng.normal(size=(3, 4)).astype(np.float32), "b": rng.normal(size=4).astype(np.float32)}
    body = (
        G.Op("core.constant", (), ("w",), {"tensor": "w"}),
        G.Op("core.constant", (), ("b",), {"tensor": "b"}),
        G.Op("tensor.matmul", ("x", "w"), ("m",)),
        G.Op("tensor.add", ("m", "b"), ("s",)),
        G.Op("nn.activation", ("s",), ("r",), {"kind": "relu"}),
        G.Op("tensor.reshape", ("r",), ("q",), {"shape": [4, 2]}),
        G.Op("tensor.transpose", ("q",), ("t",), {"perm": [1, 0]}),
        G.Op("tensor.softmax", ("t",), ("p",), {"axis": -1}),
        G.Op("tensor.reduce", ("p",), ("z",), {"kind": "max", "axes": [1], "keepdims": False}),
        G.Op("core.return", ("z", "p")),
    )
    module = G.Module({"main": G.Function("main", ("x",), body)})
    raw = onnx.write(module, w)
    again, weights, report = onnx.read(raw)
    assert not G.verify(again) and ("weights", "preserved") in report and np.allclose(weights["w"], w["w"])
    x = rng.normal(size=(2, 3))
    run = lambda m: [collect(t) for t in G.run(m, [literal(spark, x)], weights={n: literal(spark, a) for n, a in w.items()}).results]
    for a, b in zip(run(module), run(again), strict=True):
        assert np.allclose(a, b)
    e = np.maximum(x @ w["w"] + w["b"], 0).reshape(4, 2).T
    e = np.exp(e - e.max(1, keepdims=True))
    assert np.allclose(run(again)[1], e / e.sum(1, keepdims=True))


def test_unknown_operations_keep_their_names():
    node = onnx._put(1, "x") + onnx._put(2, "y") + onnx._put(4, "Mystery") + onnx._put(5, onnx._put_attribute("k", 3))
    graph = onnx._put(1, node) + onnx._put(11, onnx._put(1, "x")) + onnx._put(12, onnx._put(1, "y"))
    module, _, report = onnx.read(onnx._put(7, graph))
    assert module.functions["main"].body[0].name == "onnx.Mystery" and module.functions["main"].body[0].attrs == {"k": 3}
    assert ("node onnx.Mystery", "assumed") in report
    assert G.verify(module, {"onnx.Mystery"})[0][1] == "indeterminate"


def test_refusals():
    with pytest.raises(ValueError):
        onnx.write(G.Module({"main": G.Function("main", ("x",), (G.Op("tensor.sort", ("x",), ("y",)), G.Op("core.return", ("y",))))}), {})
    with pytest.raises(ValueError):
        list(onnx.fields(b"\x0a\x09ab"))
