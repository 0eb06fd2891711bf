"""Expressions, graphs and models: rules, equivalences, refusals."""

from fractions import Fraction

import numpy as np
import pytest

from tensorloom.model import Builder
from tensorloom.plans import expr as E
from tensorloom.plans import graph as G
from tensorloom.tensor import collect, literal


def lit(shape=(4, 6), name="x", to="f64"):
    return E.node("literal", source=name, shape=list(shape), dtype=to)


def test_types():
    x = lit()
    assert E.infer(E.node("matmul", x, E.node("transpose", x))).shape == (4, 4)
    assert E.infer(E.node("concat", x, x, axis=1)).shape == (4, 12)
    assert E.infer(E.node("add", lit(to="f16"), lit(to="f32"))).dtype.name == "f32"
    assert E.infer(E.node("add", lit(to="f16"), lit(to="bf16"))).dtype.name == "f16"
    for bad in (
        lambda: E.node("reshape", x, shape=[5, 5]),
        lambda: E.node("matmul", x, x),
        lambda: E.node("slice", x, starts=[0, 3], sizes=[4, 4]),
        lambda: E.node("concat", x, lit((3, 6)), axis=1),
        lambda: E.node("select", x, lit((2,)), feature="f"),
    ):
        with pytest.raises(E.TypeFault):
            E.infer(bad())
    with pytest.raises(E.TypeFault):
        E.node("nothing")
    deep = x
    for _ in range(300):
        deep = E.Expr("approx", (deep,), (("bound", 0.1),))
    with pytest.raises(E.TypeFault):
        E.infer(deep)
    assert E.check_declared(x, (4, 6), "f64")[0] == "valid" and E.check_declared(x, (4, 6), "f32")[0] == "invalid"


def test_normal_form():
    x, y = lit(), lit(name="y")
    twice = E.node("scale", E.node("scale", x, k=Fraction(1, 3)), k=3)
    assert E.normalize(twice) == x and E.identity(twice) == E.identity(x)
    assert E.identity(E.node("add", x, y)) == E.identity(E.node("add", y, x))
    assert E.identity(E.node("sub", x, y)) != E.identity(E.node("sub", y, x))
    a, b = lit(to="f16"), lit(name="y", to="bf16")
    assert E.identity(E.node("add", a, b)) != E.identity(E.node("add", b, a))
    p = E.node("permute", E.node("permute", lit((2, 3, 4)), perm=[1, 2, 0]), perm=[2, 0, 1])
    assert E.normalize(p) == lit((2, 3, 4))
    assert E.normalize(E.node("cast", E.node("cast", x, dtype="f16"), dtype="f16")) == E.node("cast", x, dtype="f16")
    assert E.normalize(E.node("reshape", E.node("zeros", shape=[4]), shape=[2, 2])).op == "full"


def test_dependencies():
    x = lit((10, 6))
    assert E.deps(E.node("slice", x, starts=[2, 0], sizes=[4, 6]), 6, 12) == [E.Dep("x", 18, 24, True)]
    assert not E.deps(E.node("permute", x, perm=[1, 0]), 0, 6)[0].exact
    both = E.deps(E.node("concat", x, lit((10, 6), "y"), axis=0), 30, 90)
    assert [(d.source, d.low, d.high) for d in both] == [("x", 30, 60), ("y", 0, 30)]
    q = E.node("quantize", x, scheme={"formula": "sym", "q": "i8", "block": (2, 6)})
    assert [(d.low, d.high, d.exact) for d in E.deps(q, 6, 12)] == [(0, 12, False)]


def test_plugins_and_refusals(spark):
    x = literal(spark, [1.0, 2.0])
    ctx = E.Context(spark, {"x": x.cells()})
    e = E.node("plugin", lit((2,)), E.node("scale", lit((2,)), k=10), ns="n", name="f", shape=[2], fallback=True)
    assert collect(E.lower(e, ctx)).tolist() == [10, 20]
    ctx.plugins[("n", "f", 1)] = lambda t: t.map(lambda v: v + 1)
    assert collect(E.lower(e, ctx)).tolist() == [2, 3]
    assert E.with_fallbacks(e, set()).op == "scale" and E.with_fallbacks(e, {("n", "f", 1)}).op == "plugin"
    with pytest.raises(NotImplementedError):
        E.lower(E.node("plugin", lit((2,)), ns="n", name="g", shape=[2]), ctx)
    with pytest.raises(PermissionError):
        E.lower(E.node("extern", uri="http://x", shape=[2]), ctx)
    pick = E.node("select", lit((2,)), E.node("scale", lit((2,)), k=5), feature="fast")
    assert collect(E.lower(pick, ctx)).tolist() == [5, 10]
    kept = ctx.keep(pick)
    assert ctx.keep(pick) is kept


def test_model(spark):
    a = np.arange(12.0).reshape(3, 4)
    m = Builder(spark).add("w", literal(spark, a).cells(), (3, 4), "f32").derive("h", E.node("scale", lit((3, 4), "w", "f32"), k=0.5)).build()
    assert collect(m.tensor("h")).tolist() == (a / 2).tolist()
    assert {r.rule + r.name: r.status for r in m.verify().collect()}["R-T01w"] == "valid"
    assert {r.kind for r in m.delta(m).collect()} == {"identical"}
    plan, unmet = m.resolve(spark.createDataFrame([("f32", "yes"), ("f16", "yes"), ("i8", "refused")], "feature string, support string"), "min-memory")
    assert {r.repr for r in plan.collect()} == {"f16"} and unmet.isEmpty()
    assert m.cast("f16").inspect().where("dtype = 'f16'").count() == 2


# -- graphs -----------------------------------------------------------------------------------

RNG = np.random.default_rng(0)


def weights(spark, shapes):
    return {n: RNG.normal(size=s) / 2 for n, s in shapes.items()}


def run(spark, module, args, w, **k):
    assert not G.verify(module), G.verify(module)
    out = G.run(module, [literal(spark, a) for a in args], weights={n: literal(spark, a) for n, a in w.items()}, spark=spark, **k)
    return [collect(t) for t in out.results]


def test_decoder_lowered_equals_itself_and_is_causal(spark):
    p = {"layers": 1, "hidden": 8, "heads": 2, "length": 4}
    m = G.synthesize("transformer.decoder", p)
    shapes = {"embed.weight": (11, 8), "norm.weight": (8,), "head.weight": (11, 8), "layers.0.norm1.weight": (8,), "layers.0.norm2.weight": (8,)}
    shapes |= {f"layers.0.{n}.weight": (8, 8) for n in ("q", "k", "v", "o")} | {f"layers.0.{n}.weight": (16, 8) for n in ("gate", "up")} | {"layers.0.down.weight": (8, 16)}
    w = weights(spark, shapes)
    (a,) = run(spark, m, [[1.0, 5.0, 2.0, 7.0]], w)
    lowered, n = G.rewrite(m, G.LOWERINGS)
    assert n >= 4
    (b,) = run(spark, lowered, [[1.0, 5.0, 2.0, 7.0]], w)
    assert np.allclose(a, b) and np.abs(a).max() > 0.1
    (c,) = run(spark, m, [[1.0, 5.0, 2.0, 3.0]], w)
    assert np.allclose(a[:3], c[:3]) and not np.allclose(a[3], c[3])


def test_mixture_of_experts(spark):
    p = {"layers": 1, "hidden": 4, "heads": 1, "length": 3, "top_k": 2}
    m = G.synthesize("transformer.moe", p)
    shapes = {"embed.weight": (7, 4), "norm.weight": (4,), "head.weight": (7, 4), "layers.0.norm1.weight": (4,), "layers.0.norm2.weight": (4,), "layers.0.router": (4, 3), "layers.0.experts.up": (3, 5, 4), "layers.0.experts.down": (3, 4, 5)}
    shapes |= {f"layers.0.{n}.weight": (4, 4) for n in ("q", "k", "v", "o")}
    (a,) = run(spark, m, [[1.0, 2.0, 3.0]], weights(spark, shapes))
    assert a.shape == (3, 7) and np.isfinite(a).all()


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_recurrent_networks(spark):
    x = RNG.normal(size=(3, 2))
    w = weights(spark, {"cell.x.weight": (12, 2), "cell.x.bias": (12,), "cell.h.weight": (12, 3)})
    last, every = run(spark, G.synthesize("rnn.lstm", {"hidden": 3, "in": 2}), [x], w)
    h, c = np.zeros(3), np.zeros(3)
    for k in range(3):
        g = w["cell.x.weight"] @ x[k] + w["cell.x.bias"] + w["cell.h.weight"] @ h
        i, f, u, o = g[:3], g[3:6], g[6:9], g[9:]
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(u)
        h = _sigmoid(o) * np.tanh(c)
        assert np.allclose(every[k], h)
    assert np.allclose(last[0], np.concatenate([h, c]))
    w = weights(spark, {"cell.x.weight": (9, 2), "cell.x.bias": (9,), "cell.h.weight": (9, 3), "cell.h.bias": (9,)})
    _, every = run(spark, G.synthesize("rnn.gru", {"hidden": 3, "in": 2}), [x], w)
    h = np.zeros(3)
    for k in range(3):
        gx, gh = w["cell.x.weight"] @ x[k] + w["cell.x.bias"], w["cell.h.weight"] @ h + w["cell.h.bias"]
        z, s = _sigmoid(gx[:3] + gh[:3]), _sigmoid(gx[3:6] + gh[3:6])
        u = np.tanh(gx[6:] + s * gh[6:])
        h = u + z * (h - u)
        assert np.allclose(every[k], h)


def test_other_families(spark):
    nodes, src, dst = RNG.normal(size=(4, 3)), np.array([0.0, 1, 2]), np.array([1.0, 1, 3])
    w = weights(spark, {"layers.0.message.weight": (3, 3), "layers.0.self.weight": (3, 3)})
    (got,) = run(spark, G.synthesize("gnn.mpnn", {"layers": 1, "nodes": 4, "edges": 3, "hidden": 3}), [nodes, src, dst], w)
    agg = np.zeros((4, 3))
    for s, d in zip(src.astype(int), dst.astype(int), strict=True):
        agg[d] += w["layers.0.message.weight"] @ nodes[s]
    assert np.allclose(got, np.maximum(nodes @ w["layers.0.self.weight"].T + agg, 0))
    w = weights(spark, {"trunk.0.weight": (5, 3), "trunk.0.bias": (5,), "actor.weight": (2, 5), "actor.bias": (2,), "critic.weight": (1, 5), "critic.bias": (1,)})
    policy, value = run(spark, G.synthesize("rl.actor_critic", {"layers": 1}), [nodes], w)
    assert np.allclose(policy.sum(1), 1) and value.shape == (4, 1)
    w = weights(spark, {"convs.0.weight": (2, 1, 3, 3), "convs.0.bias": (2,), "head.weight": (3, 2), "head.bias": (3,)})
    (got,) = run(spark, G.synthesize("cnn.classifier", {"layers": 1}), [RNG.normal(size=(1, 1, 4, 4))], w)
    assert got.shape == (1, 3)
    w = weights(spark, {"convs.0.weight": (2, 3, 2), "convs.0.bias": (2,)})
    (got,) = run(spark, G.synthesize("audio.encoder", {"layers": 1}), [RNG.normal(size=(1, 3, 5))], w)
    assert got.shape == (1, 2, 5)
    w = weights(spark, {"in_x.weight": (3, 2), "in_z.weight": (3, 2), "conv.weight": (3, 1, 2), "conv.bias": (3,), "dt.weight": (3, 3), "dt.bias": (3,), "b.weight": (2, 3), "c.weight": (2, 3), "a": (3, 2), "d": (3,), "out.weight": (2, 3)})
    w["a"] = -np.abs(w["a"])
    (got,) = run(spark, G.synthesize("ssm.mamba", {"channels": 3, "length": 4, "states": 2}), [RNG.normal(size=(4, 2))], w)
    assert got.shape == (4, 2) and np.isfinite(got).all()


def test_control_flow(spark):
    c = G.Op("core.constant", (), ("k",), {"value": 3.0})
    yes = G.Function("yes", (), (G.Op("tensor.add", ("x", "k"), ("y",)), G.Op("core.yield", ("y",))))
    no = G.Function("no", (), (G.Op("core.yield", ("x",)),))
    m = G.Module({"main": G.Function("main", ("c", "x"), (c, G.Op("core.if", ("c",), ("z",), {}, (yes, no)), G.Op("core.return", ("z",))))})
    assert run(spark, m, [1.0, 2.0], {})[0] == 5 and run(spark, m, [0.0, 2.0], {})[0] == 2
    body = G.Function("b", ("t",), (G.Op("tensor.mul", ("t", "t"), ("s",)), G.Op("core.yield", ("s",))))
    m = G.Module({"main": G.Function("main", ("x",), (G.Op("core.map", ("x",), ("y",), {"axis": 1}, (body,)), G.Op("core.return", ("y",))))})
    assert run(spark, m, [[[1.0, 2.0], [3.0, 4.0]]], {})[0].tolist() == [[1, 4], [9, 16]]
    always = G.Function("t", ("s",), (G.Op("core.constant", (), ("o",), {"value": 1.0}), G.Op("core.yield", ("o",))))
    same = G.Function("b", ("s",), (G.Op("core.yield", ("s",)),))
    m = G.Module({"main": G.Function("main", ("x",), (G.Op("core.while", ("x",), ("y",), {"max_iters": 3}, (always, same)), G.Op("core.return", ("y",))))})
    with pytest.raises(RuntimeError):
        run(spark, m, [1.0], {})


def test_graph_refusals_and_names(spark):
    m = G.Module({"main": G.Function("main", ("x",), (G.Op("io.external", ("x",), ("y",), {"id": "e"}), G.Op("core.return", ("y",))))})
    with pytest.raises(G.Refused):
        run(spark, m, [1.0], {})
    m = G.Module({"main": G.Function("main", ("x",), (G.Op("own.op", ("x",), ("y",)), G.Op("core.return", ("y",))))}, dialects={"own": 1, "core": 1})
    assert [s for _, s, _ in G.verify(m, {"own.op"})] == ["indeterminate"]
    out = G.run(m, [literal(spark, 2.0)], shipped={"own.op": lambda x: x.map(lambda v: v * 7)})
    assert collect(out.results[0]) == 14
    f = G.Function("main", ("x", "y"), (G.Op("tensor.add", ("x", "y"), ("z",)), G.Op("io.output", ("z",), (), {"name": "sum"}), G.Op("core.assert", ("x",), (), {"message": "zero"}), G.Op("core.return", ("z",))), {"x": ("n",), "y": ("n",)})
    out = G.run(G.Module({"main": f}), [literal(spark, [1.0, 2.0])] * 2)
    assert out.dims == {"n": 2} and collect(out.outputs["sum"]).tolist() == [2, 4]
    with pytest.raises(ValueError):
        G.run(G.Module({"main": f}), [literal(spark, [1.0, 2.0]), literal(spark, [1.0])])
    with pytest.raises(AssertionError):
        G.run(G.Module({"main": f}), [literal(spark, [0.0, 2.0])] * 2)
    assert "tensor.add(x, y)" in G.show(G.Module({"main": f}))
    old = G.Module({"main": G.Function("main", ("q",), (G.Op("nn.attention", ("q", "q", "q"), ("y",)), G.Op("core.return", ("y",))))})
    new, n = G.rewrite(old, G.MIGRATIONS)
    assert n == 1 and new.functions["main"].body[0].version == 2 and G.rewrite(new, G.MIGRATIONS)[1] == 0
