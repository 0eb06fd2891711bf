"""Queries that go through expressions, models, graphs and streams."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Builder
from ..plans import expr as E
from ..plans import graph as G
from ..scratch import fresh
from ..streaming import ingest
from ..tensor import literal
from .tensors import E_SQL, N, load, tidy, vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _model(spark: SparkSession, sf_dir: str):
    e = vectors(spark, sf_dir)
    b = Builder(spark).add("e", e.cells(), e.shape)
    x = E.node("literal", source="e", shape=list(e.shape), dtype="f64")
    b.derive("twice", E.node("scale", E.node("scale", x, k=4), k=0.5))
    b.derive("part", E.node("slice", x, starts=[5, 0], sizes=[e.shape[0] - 10, 64]))
    b.derive("bf", E.node("cast", E.node("add", E.node("mul", x, x), x), dtype="bf16"))
    b.derive("gram", E.node("matmul", x, E.node("transpose", x)))
    b.derive("int8", E.node("quantize", x, scheme={"formula": "sym", "q": "i8", "block": (1, 16)}))
    return b.build()


@query("expr_scale", f"WITH e AS ({E_SQL}) SELECT r * 64 + c AS pos, round(2 * v, 6) + 0.0 AS v FROM e")
def _scale(spark, sf_dir):
    return tidy(_model(spark, sf_dir).tensor("twice"))


@query("expr_range", f"WITH e AS ({E_SQL}) SELECT (r - 5) * 64 + c AS pos, round(v, 6) + 0.0 AS v FROM e WHERE r >= 5 AND (r - 5) * 64 + c >= 100 AND (r - 5) * 64 + c < 200")
def _range(spark, sf_dir):
    return _model(spark, sf_dir).evaluate("part", 100, 200).select("pos", (F.round("v", 6) + 0.0).alias("v"))


@query("expr_deps", "SELECT * FROM (VALUES ('e', 420, 520, true, '')) AS t(source, low, high, exact, reason)")
def _deps(spark, sf_dir):
    return _model(spark, sf_dir).deps("part", 100, 200)


@query("expr_flatten", f"WITH e AS ({E_SQL}) SELECT r * 64 + c AS pos, round(2 * (v + 2 * v), 6) + 0.0 AS v FROM e")
def _flatten(spark, sf_dir):
    """A grandchild's expression over its base alone."""
    e = vectors(spark, sf_dir)
    base, child = (E.node("literal", source=n, shape=list(e.shape), dtype="f64") for n in ("e", "child"))
    parents = {"child": E.node("add", base, E.node("scale", base, k=2))}
    whole = E.flatten(E.node("scale", child, k=2), parents, 1)
    return tidy(E.lower(whole, E.Context(spark, {"e": e.cells()})))


@query("expr_plugin", f"WITH e AS ({E_SQL}) SELECT r * 64 + c AS pos, round(v * 10 + 1, 6) + 0.0 AS v FROM e")
def _plugin(spark, sf_dir):
    """A plugin without a provider gives its fallback, a chosen feature its branch."""
    e = vectors(spark, sf_dir)
    x = E.node("literal", source="e", shape=list(e.shape), dtype="f64")
    call = E.node("plugin", x, E.node("scale", x, k=10), ns="n", name="f", shape=list(e.shape), fallback=True)
    known = E.node("plugin", call, ns="n", name="g", shape=list(e.shape))
    pick = E.node("select", known, x, feature="fast")
    ctx = E.Context(spark, {"e": e.cells()}, plugins={("n", "g", 1): lambda t: t.map(lambda v: v + 1)}, features={"fast"})
    return tidy(E.lower(pick, ctx))


@query("expr_matmul", f"WITH e AS ({E_SQL}) SELECT a.r * {N} + b.r AS pos, round(sum(a.v * b.v), 5) + 0.0 AS v FROM e a JOIN e b ON a.c = b.c GROUP BY a.r, b.r")
def _matmul(spark, sf_dir):
    return tidy(_model(spark, sf_dir).tensor("gram"), 5)


@query("model_inspect", f"SELECT name, dtype, CAST(elements AS BIGINT) AS elements FROM (SELECT n, unnest([{{'name': 'bf', 'dtype': 'bf16', 'elements': n * 64}}, {{'name': 'e', 'dtype': 'f64', 'elements': n * 64}}, {{'name': 'gram', 'dtype': 'f64', 'elements': n * n}}, {{'name': 'int8', 'dtype': 'i8', 'elements': n * 64}}, {{'name': 'part', 'dtype': 'f64', 'elements': (n - 10) * 64}}, {{'name': 'twice', 'dtype': 'f64', 'elements': n * 64}}], recursive := true) FROM (SELECT {N} AS n))")
def _inspect(spark, sf_dir):
    return _model(spark, sf_dir).inspect().select("name", "dtype", "elements")


@query("model_verify", "SELECT * FROM (VALUES ('R-T01', 'indeterminate', 5), ('R-T01', 'valid', 1), ('R-O05', 'valid', 6)) AS t(rule, status, n)")
def _verify(spark, sf_dir):
    return _model(spark, sf_dir).verify().groupBy("rule", "status").agg(F.count("*").alias("n"))


@query("model_stats", f"WITH e AS ({E_SQL}) SELECT 'e' AS tensor, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n FROM e UNION ALL SELECT 'twice', round(min(2 * v), 6), round(max(2 * v), 6), count(*) FROM e")
def _stats(spark, sf_dir):
    got = _model(spark, sf_dir).stats(["e", "twice"])
    return got.select("tensor", F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), "n")


def _weights(spark, module: G.Module, shapes: dict[str, tuple]):
    """Fixed small weights: the value of cell i of the k-th name is sin-like but exact."""
    out = {}
    for k, (name, shape) in enumerate(sorted(shapes.items())):
        n = 1
        for x in shape:
            n *= x
        values = [((i * 7 + k * 3) % 11 - 5) / 8 for i in range(n)]
        t = literal(spark, values)
        out[name] = t.with_cells(t.cells(), shape)
    return out


@query("graph_mlp", f"WITH e AS ({E_SQL}), w AS (SELECT o, i, ((o * 64 + i) * 7 + 3) % 11 - 5 AS w FROM generate_series(0, 3) AS a(o), generate_series(0, 63) AS b(i)) SELECT r * 4 + o AS pos, round(sum(v * w / 8.0) + ((o * 7) % 11 - 5) / 8.0, 5) + 0.0 AS v FROM e JOIN w ON w.i = e.c GROUP BY r, o")
def _mlp(spark, sf_dir):
    m = G.synthesize("mlp", {"layers": 1})
    return tidy(G.run(m, [vectors(spark, sf_dir)], weights=_weights(spark, m, {"layers.0.bias": (4,), "layers.0.weight": (4, 64)})).results[0], 5)


@query("graph_lowered_norm", f"WITH e AS ({E_SQL}) SELECT r * 64 + c AS pos, round(v / sqrt(avg(v * v) OVER (PARTITION BY r) + 1e-5), 5) + 0.0 AS v FROM e")
def _lowered(spark, sf_dir):
    f = G.Function("main", ("x",), (G.Op("nn.norm", ("x",), ("y",), {"kind": "rms"}), G.Op("core.return", ("y",))))
    m, n = G.rewrite(G.Module({"main": f}), G.LOWERINGS)
    assert n == 1
    return tidy(G.run(m, [vectors(spark, sf_dir)]).results[0], 5)


@query("graph_while", "SELECT 0 AS pos, 64.0 AS v")
def _while(spark, sf_dir):
    test = G.Function("test", ("s",), (G.Op("core.constant", (), ("c",), {"value": 50.0}), G.Op("tensor.sub", ("c", "s"), ("d",)), G.Op("nn.activation", ("d",), ("r",), {"kind": "relu"}), G.Op("core.yield", ("r",))))
    body = G.Function("body", ("s",), (G.Op("tensor.add", ("s", "s"), ("t",)), G.Op("core.yield", ("t",))))
    f = G.Function("main", ("x",), (G.Op("core.while", ("x",), ("y",), {}, (test, body)), G.Op("core.return", ("y",))))
    return G.run(G.Module({"main": f}), [literal(spark, 1.0)]).results[0].cells()


@query("graph_verify", "SELECT * FROM (VALUES ('R-I02', 'invalid', 1), ('R-I05', 'invalid', 1), ('R-I07', 'invalid', 2), ('R-I08', 'invalid', 1), ('R-I09', 'invalid', 1), ('R-I10', 'invalid', 1), ('R-I11', 'invalid', 1)) AS t(rule, status, n)")
def _verify_graph(spark, sf_dir):
    body = (
        G.Op("tensor.add", ("x", "gone"), ("y",)),
        G.Op("tensor.reduce", ("y",), ("z",), {"kind": "sum"}),
        G.Op("tensor.exp", ("y", "z"), ("w",)),
        G.Op("tensor.nothing", ("w",), ("u",)),
        G.Op("core.constant", (), ("c",), {"tensor": "weight"}),
        G.Op("core.return", ("w",)),
    )
    f = G.Function("main", ("x",), body, types={"c": (4, 4), "y": "token"}, limits={"n": (8, 12, 16)})
    rows = G.verify(G.Module({"main": f}, lowered_from="sha256:0"), weights={"weight": (4, 5)})
    return spark.createDataFrame(rows, "rule string, status string, place string").groupBy("rule", "status").agg(F.count("*").alias("n"))


@query("graph_shapes", f"SELECT value, n, ok FROM (SELECT unnest(['x', 'y', 'z']) AS value, unnest([{N} * 64, {N} * {N}, {N}]) AS n, unnest([true, true, false]) AS ok)")
def _shapes_of(spark, sf_dir):
    """Shapes of all values, inferred without reading one, against declared ones of which the last is wrong."""
    e = vectors(spark, sf_dir)
    n = e.shape[0]
    body = (G.Op("tensor.einsum", ("x", "x"), ("y",), {"equation": "ik,jk->ij"}), G.Op("tensor.reduce", ("y",), ("z",), {"kind": "max", "axes": [1]}), G.Op("core.return", ("z",)))
    m = G.Module({"main": G.Function("main", ("x",), body, types={"x": e.shape, "y": (n, n), "z": (n, 1)})})
    got, rows = G.infer(m, [e.shape], spark), {place.rpartition(" ")[2]: status for rule, status, place in G.check_types(m, [e.shape], spark)}
    return spark.createDataFrame([(v, math.prod(s), rows[v] == "valid") for v, s in got.items()], "value string, n long, ok boolean")


@query("graph_json", "SELECT * FROM (VALUES ('mlp', true), ('transformer.decoder', true), ('cnn.classifier', true)) AS t(family, same)")
def _json(spark, sf_dir):
    """Modules written as JSON and read back are the same."""
    given = {"mlp": {"layers": 2}, "transformer.decoder": {"layers": 1, "hidden": 8, "heads": 2, "length": 4}, "cnn.classifier": {"layers": 1}}
    made = {k: G.synthesize(k, p) for k, p in given.items()}
    return spark.createDataFrame([(k, G.from_json(G.to_json(m)) == m) for k, m in made.items()], "family string, same boolean")


@query("stream_ingest", "SELECT sha256(event_type || CAST(user_id AS VARCHAR)) AS digest, CAST(max(length(event_type || CAST(user_id AS VARCHAR))) AS BIGINT) AS logical_len FROM events GROUP BY 1")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objects that arrive in a stream; every distinct one is stored once."""
    place = fresh(spark, "ingest")
    events = load(spark, sf_dir, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("payload"), F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{place}/in")
    stream = ingest.source(spark, f"{place}/in", "payload string, ts timestamp")
    ingest.store(ingest.arriving(stream, late="3650 days"), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy("digest").agg(F.max("logical_len").alias("logical_len"))
