"""Queries of the tensor operators over the given tables.

E is ``embeddings`` as a matrix [vector, 64] in order of vec_id; L is the
price column of ``lineitem`` in order of key and line.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dtypes import TYPES, round_through
from ..operators import contract, elementwise, nn, quant, reduce, sparse, structure, windowed
from ..tensor import TensorRef, arange, eye, from_cells, generate, literal

WIDTH = 64


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> TensorRef:
    """All embeddings; vec_id is the row number, and the shape comes from the table's own count."""
    df = load(spark, sf_dir, "embeddings")
    n = df.count()
    flat = df.select("vec_id", F.posexplode("embedding").alias("c", "v"))
    return from_cells(flat.select((F.col("vec_id") * WIDTH + F.col("c")).alias("pos"), "v"), (n, WIDTH))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem")


def tidy(t: TensorRef, digits: int = 6) -> DataFrame:
    """pos and v, rounded so that sums in another order compare equal; -0 becomes 0."""
    return t.cells().select("pos", (F.round("v", digits) + 0.0).alias("v"))


E_SQL = "SELECT vec_id AS r, c - 1 AS c, CAST(embedding[c] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) AS g(c)"


def _line_query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        price, quantity, discount, tax = (F.col(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax"))
        df = lines(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), price.alias("p"), quantity.alias("q"), discount.alias("d"), tax.alias("t"))
        base = {c: TensorRef(df, (1 << 40,), F.col(c), _F64) for c in "pqdt"}
        out = f(base)
        return out.df.select("pos", (F.round(out.v, 6) + 0.0).alias("v"))

    return run


_F64 = TYPES["f64"]
_L = "SELECT l_orderkey * 8 + l_linenumber AS pos, l_extendedprice AS p, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem"


def _line_sql(v: str) -> str:
    return f"SELECT pos, round({v}, 6) + 0.0 AS v FROM ({_L})"


def _round_sql(v: str, mantissa: int, least: int) -> str:
    unit = f"pow(2.0, greatest(floor(log2(abs({v}))), {least}) - {mantissa})"
    return f"CASE WHEN {v} = 0 THEN 0 ELSE round_even({v} / {unit}, 0) * {unit} END"


LINE = {
    "ew_add": (lambda b: elementwise.add(b["p"], b["q"]), "p + q"),
    "ew_sub": (lambda b: elementwise.sub(b["p"], b["q"]), "p - q"),
    "ew_mul": (lambda b: elementwise.mul(b["p"], b["d"]), "p * d"),
    "ew_div": (lambda b: elementwise.div(b["q"], b["d"]), "CASE WHEN d = 0 THEN CAST('inf' AS DOUBLE) ELSE q / d END"),
    "ew_neg": (lambda b: elementwise.unary("neg", b["p"]), "-p"),
    "ew_exp": (lambda b: elementwise.unary("exp", b["d"]), "exp(d)"),
    "ew_log": (lambda b: elementwise.unary("log", b["d"]), "CASE WHEN d = 0 THEN CAST('-inf' AS DOUBLE) ELSE ln(CASE WHEN d = 0 THEN 1 ELSE d END) END"),
    "ew_sqrt": (lambda b: elementwise.unary("sqrt", b["q"]), "sqrt(q)"),
    "ew_rsqrt": (lambda b: elementwise.unary("rsqrt", b["q"]), "1 / sqrt(q)"),
    "ew_tanh": (lambda b: elementwise.unary("tanh", b["d"]), "(exp(2 * d) - 1) / (exp(2 * d) + 1)"),
    "ew_sigmoid": (lambda b: elementwise.unary("sigmoid", b["t"]), "1 / (1 + exp(-t))"),
    "ew_maximum": (lambda b: elementwise.maximum(b["d"], b["t"]), "greatest(d, t)"),
    "ew_minimum": (lambda b: elementwise.minimum(b["d"], b["t"]), "least(d, t)"),
    "ew_where": (lambda b: elementwise.where(b["d"], b["p"], b["q"]), "CASE WHEN d <> 0 THEN p ELSE q END"),
    "ew_clamp": (lambda b: elementwise.clamp(b["q"], 10, 30), "least(greatest(q, 10), 30)"),
    "ew_scale": (lambda b: elementwise.scale(b["q"], 0.375), "q * 0.375"),
    "ew_fused": (lambda b: elementwise.add(elementwise.mul(b["q"], b["q"]), b["q"]), "q * q + q"),
    "act_relu": (lambda b: elementwise.activation("relu", b["q"].map(lambda v: v - 25)), "greatest(q - 25, 0)"),
    "act_silu": (lambda b: elementwise.activation("silu", b["d"]), "d / (1 + exp(-d))"),
    "act_gelu_tanh": (
        lambda b: elementwise.activation("gelu_tanh", b["d"]),
        "0.5 * d * (1 + (exp(2 * (0.7978845608028654 * (d + 0.044715 * d * d * d))) - 1) / (exp(2 * (0.7978845608028654 * (d + 0.044715 * d * d * d))) + 1))",
    ),
    "act_gated": (lambda b: elementwise.activation("silu", b["d"], b["t"]), "d / (1 + exp(-d)) * t"),
    "cast_f32": (lambda b: elementwise.cast(b["p"], "f32"), "CAST(CAST(p AS FLOAT) AS DOUBLE)"),
    "cast_f16": (lambda b: elementwise.cast(b["q"].map(lambda v: v * 1.1), "f16"), _round_sql("(q * CAST(1.1 AS DOUBLE))", 10, -14)),
    "cast_bf16": (lambda b: elementwise.cast(b["p"], "bf16"), _round_sql("p", 7, -126)),
    "cast_f8e4m3": (lambda b: elementwise.cast(b["q"], "f8e4m3"), _round_sql("q", 3, -6)),
    "cast_i4": (lambda b: elementwise.cast(b["q"], "i4"), "least(greatest(round_even(q, 0), -8), 7)"),
    "xor_i32": (
        lambda b: elementwise.xor(b["q"].map(lambda v: v, TYPES["i32"]), elementwise.cast(b["p"], "i32")),
        "CAST(xor(CAST(q AS BIGINT), CAST(round_even(p, 0) AS BIGINT)) AS DOUBLE)",
    ),
}

QUERIES = {name: _line_query(f) for name, (f, _) in LINE.items()}
ORACLE_SQL = {name: _line_sql(v) for name, (_, v) in LINE.items()}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# -- reductions -----------------------------------------------------------------------

for _kind, _agg in {"sum": "sum(v)", "mean": "avg(v)", "max": "max(v)", "min": "min(v)", "any": "CAST(bool_or(v <> 0) AS DOUBLE)", "all": "CAST(bool_and(v <> 0) AS DOUBLE)"}.items():
    query(f"reduce_{_kind}", f"WITH e AS ({E_SQL}) SELECT r AS pos, round({_agg}, 6) + 0.0 AS v FROM e GROUP BY r")(lambda s, d, k=_kind: tidy(reduce.reduce(vectors(s, d), k, [1])))


@query("reduce_prod", f"WITH e AS ({E_SQL}) SELECT r AS pos, round(product(1 + v / 100), 6) + 0.0 AS v FROM e GROUP BY r")
def _prod(spark, sf_dir):
    return tidy(reduce.reduce(vectors(spark, sf_dir).map(lambda v: 1 + v / 100), "prod", [1]))


@query("reduce_columns", f"WITH e AS ({E_SQL}) SELECT c AS pos, round(sum(v), 4) + 0.0 AS v FROM e GROUP BY c")
def _columns(spark, sf_dir):
    return tidy(reduce.reduce(vectors(spark, sf_dir), "sum", [0], keepdims=True), 4)


@query("sum_kahan", f"WITH e AS ({E_SQL}) SELECT r AS pos, round(fsum(v), 6) + 0.0 AS v FROM e GROUP BY r")
def _kahan(spark, sf_dir):
    return tidy(reduce.reduce(vectors(spark, sf_dir), "sum", [1], order="kahan"))


@query("norm_l1", f"WITH e AS ({E_SQL}) SELECT r AS pos, round(sum(abs(v)), 6) + 0.0 AS v FROM e GROUP BY r")
def _l1(spark, sf_dir):
    return tidy(reduce.norm(vectors(spark, sf_dir), 1, 1))


@query("norm_l2", f"WITH e AS ({E_SQL}) SELECT r AS pos, round(sqrt(sum(v * v)), 6) + 0.0 AS v FROM e GROUP BY r")
def _l2(spark, sf_dir):
    return tidy(reduce.norm(vectors(spark, sf_dir), 1))


@query("norm_inf", f"WITH e AS ({E_SQL}) SELECT r AS pos, round(max(abs(v)), 6) + 0.0 AS v FROM e GROUP BY r")
def _linf(spark, sf_dir):
    return tidy(reduce.norm(vectors(spark, sf_dir), 1, float("inf")))


@query(
    "stats_measure",
    """SELECT l_returnflag AS tensor, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, max(abs(l_extendedprice)) AS absmax,
       CAST(0 AS BIGINT) AS nan, CAST(0 AS BIGINT) AS inf, count(*) FILTER (l_extendedprice <> 0) AS nonzero, count(*) AS n FROM lineitem GROUP BY 1""",
)
def _stats(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_returnflag").alias("tensor"), F.col("l_extendedprice").alias("v"))
    return reduce.stats(rows, ["tensor"]).withColumn("mean", F.round("mean", 4))


# -- structure ------------------------------------------------------------------------

#: The number of rows of E, and all integers below a bound, in SQL.
N = "(SELECT count(*) FROM embeddings)"


def upto(n, name: str) -> str:
    return f"(SELECT unnest(generate_series(0, CAST({n} AS BIGINT) - 1)) AS {name})"


def _shape(name: str, sql: str):
    def keep(f):
        return query(name, f"WITH e AS ({E_SQL}) {sql}")(lambda s, d: tidy(f(vectors(s, d))))

    return keep


def _image(e: TensorRef) -> TensorRef:
    return structure.reshape(e, (1, 1, *e.shape))


_shape("permute", f"SELECT c * {N} + r AS pos, round(v, 6) + 0.0 AS v FROM e")(lambda e: structure.permute(e, [1, 0]))
_shape("transpose", f"SELECT c * {N} + r AS pos, round(v, 6) + 0.0 AS v FROM e")(lambda e: structure.transpose(e))
_shape("reshape", "SELECT r * 64 + c AS pos, round(v, 6) + 0.0 AS v FROM e")(lambda e: structure.reshape(e, (-1, 16)))
_shape("slice", "SELECT (r // 2 - 1) * 10 + (c - 4) // 3 AS pos, round(v, 6) + 0.0 AS v FROM e WHERE r >= 2 AND r % 2 = 0 AND c >= 4 AND c < 34 AND (c - 4) % 3 = 0")(
    lambda e: structure.slice_(e, [2, 4], [e.shape[0], 34], [2, 3])
)
_shape("concat", "SELECT r * 128 + c AS pos, round(v, 6) + 0.0 AS v FROM e UNION ALL SELECT r * 128 + 64 + c, round(-v, 6) + 0.0 FROM e")(lambda e: structure.concat([e, elementwise.unary("neg", e)], 1))
_shape("split", "SELECT r * 40 + c - 16 AS pos, round(v, 6) + 0.0 AS v FROM e WHERE c >= 16 AND c < 56")(lambda e: structure.split(e, 1, [16, 40, 8], 1))
_shape("squeeze", "SELECT r * 64 + c AS pos, round(v, 6) + 0.0 AS v FROM e")(lambda e: structure.squeeze(structure.reshape(e, (e.shape[0], 1, WIDTH)), [1]))
_shape("broadcast_to", f"SELECT k * {N} * 64 + r * 64 + c AS pos, round(v, 6) + 0.0 AS v FROM e, generate_series(0, 2) AS g(k)")(lambda e: structure.broadcast_to(structure.reshape(e, (1, *e.shape)), (3, *e.shape)))
_shape("broadcast_add", "SELECT a.r * 64 + a.c AS pos, round(a.v + b.v, 6) + 0.0 AS v FROM e a JOIN e b ON a.c = b.c AND b.r = 0")(lambda e: elementwise.add(e, structure.slice_(e, [0, 0], [1, 64])))

_GRID = f"SELECT i, j FROM {upto(f'{N} + 5', 'i')}, {upto(68, 'j')}"
_shape("pad_constant", f"SELECT i * 68 + j AS pos, round(coalesce(v, 7), 6) + 0.0 AS v FROM ({_GRID}) LEFT JOIN e ON r = i - 2 AND c = j - 1")(lambda e: structure.pad(e, [2, 1], [3, 3], "constant", 7))
_shape("pad_edge", f"SELECT i * 68 + j AS pos, round(v, 6) + 0.0 AS v FROM (SELECT i, j, least(greatest(i - 2, 0), {N} - 1) AS y, least(greatest(j - 1, 0), 63) AS x FROM ({_GRID})) JOIN e ON r = y AND c = x")(lambda e: structure.pad(e, [2, 1], [3, 3], "edge"))
_shape("pad_reflect", f"SELECT i * 68 + j AS pos, round(v, 6) + 0.0 AS v FROM (SELECT i, j, {N} - 1 - abs({N} - 1 - abs(i - 2)) AS y, 63 - abs(63 - abs(j - 1)) AS x FROM ({_GRID})) JOIN e ON r = y AND c = x")(lambda e: structure.pad(e, [2, 1], [3, 3], "reflect"))
_shape("pad_wrap", f"SELECT i * 68 + j AS pos, round(v, 6) + 0.0 AS v FROM (SELECT i, j, (i + {N} - 2) % {N} AS y, (j + 63) % 64 AS x FROM ({_GRID})) JOIN e ON r = y AND c = x")(lambda e: structure.pad(e, [2, 1], [3, 3], "wrap"))
_shape("gather", f"SELECT k * 64 + c AS pos, round(v, 6) + 0.0 AS v FROM (SELECT k, (k * 7 + 3) % {N} AS i FROM {upto(N, 'k')}) JOIN e ON r = i")(lambda e: structure.gather(e, generate(e.spark, (e.shape[0],), lambda p: (p * 7 + 3) % e.shape[0]), 0))
_shape("gather_columns", "SELECT r * 3 + k AS pos, round(v, 6) + 0.0 AS v FROM e JOIN (VALUES (0, 63), (1, 1), (2, 1)) AS g(k, i) ON c = i")(lambda e: structure.gather(e, literal(e.spark, [63, 1, 1]), 1))
_shape("nn_embedding", f"SELECT k * 64 + c AS pos, round(v, 6) + 0.0 AS v FROM (SELECT k, (k * 3 + 1) % {N} AS i FROM {upto(N, 'k')}) JOIN e ON r = i")(lambda e: structure.embedding(e, generate(e.spark, (e.shape[0],), lambda p: (p * 3 + 1) % e.shape[0])))
for _red, _sql in {"add": "e.v + coalesce(sum(u.v), 0)", "max": "greatest(e.v, coalesce(max(u.v), e.v))", "min": "least(e.v, coalesce(min(u.v), e.v))", "mul": "e.v * coalesce(product(u.v), 1)", "replace": "coalesce(max_by(u.v, u.r), e.v)"}.items():
    _shape(
        f"scatter_{_red}",
        f"SELECT e.r * 64 + e.c AS pos, round({_sql}, 6) + 0.0 AS v FROM e LEFT JOIN (SELECT r, c, v, (r * 7) % (({N} + 3) // 4) AS i FROM e) u ON u.i = e.r AND u.c = e.c GROUP BY e.r, e.c, e.v",
    )(lambda e, red=_red: structure.scatter(e, generate(e.spark, e.shape, lambda p: (F.expr("pos div 64L") * 7) % ((e.shape[0] + 3) // 4)), e, 0, red))
_shape("eye_add", "SELECT r * 64 + c AS pos, round(v + CASE WHEN r = c THEN 1 ELSE 0 END, 6) + 0.0 AS v FROM e")(lambda e: elementwise.add(e, eye(e.spark, *e.shape)))
_shape("arange_mul", "SELECT r * 64 + c AS pos, round(v * (2 + 0.5 * c), 6) + 0.0 AS v FROM e")(lambda e: elementwise.mul(e, arange(e.spark, 64, 2, 0.5)))

# -- contractions and windows ---------------------------------------------------------

_shape("matmul", f"SELECT a.r * {N} + b.r AS pos, round(sum(a.v * b.v), 5) + 0.0 AS v FROM e a JOIN e b ON a.c = b.c GROUP BY a.r, b.r")(lambda e: contract.matmul(e, structure.transpose(e)).map(lambda v: F.round(v, 5)))
_shape("einsum_bilinear", "SELECT a.r AS pos, round(sum(a.v * b.v * g.v), 4) + 0.0 AS v FROM e a JOIN e b ON a.r = b.r JOIN e g ON g.r = a.c AND g.c = b.c GROUP BY a.r")(
    lambda e: contract.einsum("ri,rj,ij->r", e, e, structure.slice_(e, [0, 0], [64, 64])).map(lambda v: F.round(v, 4))
)
_shape("einsum_trace", "SELECT r AS pos, round(sum(v), 6) + 0.0 AS v FROM e WHERE c // 8 = c % 8 GROUP BY r")(lambda e: contract.einsum("rii->r", structure.reshape(e, (e.shape[0], 8, 8))))
_shape("matmul_pairwise", "SELECT a.r * 4 + b.r AS pos, round(sum(a.v * b.v), 5) + 0.0 AS v FROM e a JOIN e b ON a.c = b.c AND b.r < 4 GROUP BY a.r, b.r")(
    lambda e: contract.matmul(e, structure.transpose(structure.slice_(e, [0, 0], [4, 64])), order="pairwise").map(lambda v: F.round(v, 5))
)
_shape("linear", "SELECT a.r * 64 + b.r AS pos, round(sum(a.v * b.v) + max(g.v), 5) + 0.0 AS v FROM e a JOIN e b ON a.c = b.c AND b.r < 64 JOIN e g ON g.r = 0 AND g.c = b.r GROUP BY a.r, b.r")(
    lambda e: contract.linear(e, structure.slice_(e, [0, 0], [64, 64]), structure.reshape(structure.slice_(e, [0, 0], [1, 64]), (64,))).map(lambda v: F.round(v, 5))
)


@query(
    "gram_topk",
    f"""WITH e AS ({E_SQL}), n AS (SELECT r, sqrt(sum(v * v)) AS n FROM e GROUP BY r),
    s AS (SELECT a.r AS q, b.r AS k, sum((a.v / na.n) * (b.v / nb.n)) AS s FROM e a JOIN e b ON a.c = b.c JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r WHERE a.r % 100 = 0 GROUP BY ALL),
    t AS (SELECT q, k, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, k) AS rank FROM s)
    SELECT q AS row, rank - 1 AS rank, k AS neighbour, round(s, 6) AS score FROM t WHERE rank <= 5""",
)
def gram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose number is divisible by 100 are the queries, against all rows."""
    e = vectors(spark, sf_dir)
    values, index = nn.cosine_topk(e, structure.slice_(e, [0, 0], list(e.shape), [100, 1]), 5)
    both = values.df.select("pos", values.v.alias("score"), index.v.alias("k"))  # both are columns of one table
    return both.select((F.expr("pos div 5L") * 100).alias("row"), (F.col("pos") % 5).alias("rank"), F.col("k").cast("long").alias("neighbour"), F.round("score", 6).alias("score"))


_shape("softmax", "SELECT r * 64 + c AS pos, round(exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w), 6) + 0.0 AS v FROM e WINDOW w AS (PARTITION BY r)")(lambda e: windowed.softmax(e))
_shape("cumsum", "SELECT r * 64 + c AS pos, round(sum(v) OVER (PARTITION BY r ORDER BY c), 6) + 0.0 AS v FROM e")(lambda e: windowed.cumsum(e))
_shape("sort_axis", "SELECT r * 64 + row_number() OVER (PARTITION BY r ORDER BY v, c) - 1 AS pos, round(v, 6) + 0.0 AS v FROM e")(lambda e: windowed.sort(e))
_shape("sort_descending", "SELECT (row_number() OVER (PARTITION BY c ORDER BY v DESC, r) - 1) * 64 + c AS pos, round(v, 6) + 0.0 AS v FROM e")(lambda e: windowed.sort(e, 0, True))
_shape("topk", "SELECT r * 5 + k AS pos, round(v, 6) + 0.0 AS v FROM (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) - 1 AS k FROM e) WHERE k < 5")(lambda e: windowed.topk(e, 5)[0])
_shape("topk_index", "SELECT r * 5 + k AS pos, CAST(c AS DOUBLE) AS v FROM (SELECT r, c, row_number() OVER (PARTITION BY r ORDER BY v DESC, c) - 1 AS k FROM e) WHERE k < 5")(lambda e: windowed.topk(e, 5)[1])
_shape("rms_norm", "SELECT r * 64 + c AS pos, round(v / sqrt(avg(v * v) OVER (PARTITION BY r) + 1e-5), 6) + 0.0 AS v FROM e")(lambda e: windowed.layer_norm(e, kind="rms"))
_shape("layer_norm", "SELECT r * 64 + c AS pos, round((v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5), 6) + 0.0 AS v FROM e WINDOW w AS (PARTITION BY r)")(lambda e: windowed.layer_norm(e))

# -- neural-network operators ---------------------------------------------------------

_shape(
    "rope",
    "SELECT a.r * 64 + a.c AS pos, round(CASE WHEN a.c < 32 THEN a.v * cos(x) - b.v * sin(x) ELSE b.v * sin(x) + a.v * cos(x) END, 6) + 0.0 AS v FROM (SELECT *, r * pow(10000.0, -2.0 * (c % 32) / 64) AS x FROM e) a JOIN e b ON a.r = b.r AND b.c = (a.c + 32) % 64",
)(lambda e: nn.rope(e))
_shape(
    "rope_interleaved",
    "SELECT a.r * 64 + a.c AS pos, round(CASE WHEN a.c % 2 = 0 THEN a.v * cos(x) - b.v * sin(x) ELSE b.v * sin(x) + a.v * cos(x) END, 6) + 0.0 AS v FROM (SELECT *, r * pow(10000.0, -2.0 * (c // 2) / 64) AS x FROM e) a JOIN e b ON a.r = b.r AND b.c = a.c + 1 - 2 * (a.c % 2)",
)(lambda e: nn.rope(e, interleaved=True))


def _heads(e: TensorRef) -> TensorRef:
    """[n, 64] as [1, 4, n, 16]."""
    n = e.shape[0]
    return structure.reshape(structure.permute(structure.reshape(e, (n, 4, 16)), [1, 0, 2]), (1, 4, n, 16))


_ATT = f"""WITH e AS ({E_SQL}), q AS (SELECT c // 16 AS h, r AS i, c % 16 AS d, v FROM e),
    s AS (SELECT a.h, a.i, b.i AS j, sum(a.v * b.v) / 4 AS s FROM q a JOIN q b ON a.h = b.h AND a.d = b.d WHERE {{keep}} GROUP BY ALL),
    p AS (SELECT h, i, j, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY h, i) AS p FROM (SELECT *, max(s) OVER (PARTITION BY h, i) AS m FROM s)),
    o AS (SELECT p.h, p.i, q.d, sum(p * v) AS v FROM p JOIN q ON q.h = p.h AND q.i = p.j GROUP BY ALL)
    SELECT h * {N} * 16 + i * 16 + d AS pos, round(v, 5) + 0.0 AS v FROM o"""
for _name, _keep, _options in (("attention", "true", {}), ("attention_causal", "b.i <= a.i", {"causal": True}), ("attention_window", "b.i <= a.i AND b.i > a.i - 4", {"causal": True, "window": 4})):
    query(_name, _ATT.format(keep=_keep))(lambda s, d, o=_options: tidy(nn.attention(*[_heads(vectors(s, d))] * 3, **o), 5))


@query(
    "moe_route",
    f"""WITH e AS ({E_SQL}), w AS (SELECT r AS x, c AS k, v FROM e WHERE r < 64 AND c < 8),
    s AS (SELECT a.r, w.k, sum(a.v * w.v) AS s FROM e a JOIN w ON a.c = w.x GROUP BY ALL),
    p AS (SELECT r, k, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY r) AS p FROM (SELECT *, max(s) OVER (PARTITION BY r) AS m FROM s)),
    t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, k) AS rank FROM p)
    SELECT r AS token, rank - 1 AS rank, k AS expert, round(p / sum(p) OVER (PARTITION BY r), 5) AS weight FROM t WHERE rank <= 2""",
)
def _moe(spark, sf_dir):
    """All rows are tokens; the first 64 rows' first columns are the router's weights."""
    e = vectors(spark, sf_dir)
    weights, index = nn.moe_route(e, structure.slice_(e, [0, 0], [64, 8]), top_k=2, normalize=True)
    both = weights.cells().withColumnRenamed("v", "w").join(index.cells().withColumnRenamed("v", "k"), "pos")
    return both.select(F.expr("pos div 2L").alias("token"), (F.col("pos") % 2).alias("rank"), F.col("k").cast("long").alias("expert"), F.round("w", 5).alias("weight"))


_shape("pool_avg", f"SELECT (r // 2) * 16 + c // 4 AS pos, round(avg(v), 6) + 0.0 AS v FROM e WHERE r < {N} // 2 * 2 GROUP BY ALL")(lambda e: nn.pool(_image(e), "avg", [2, 4]))
_shape("pool_max", f"SELECT o * 64 + c AS pos, round(max(v), 6) + 0.0 AS v FROM e, {upto(f'({N} - 4) // 2 + 1', 'o')} WHERE r >= o * 2 AND r < o * 2 + 4 GROUP BY ALL")(lambda e: nn.pool(_image(e), "max", [4, 1], [2, 1]))
_shape("conv1d_causal", "SELECT a.r * 64 + a.c AS pos, round(sum(b.v * (k.i + 1)), 5) + 0.0 AS v FROM e a JOIN (VALUES (0), (1), (2)) AS k(i) ON true JOIN e b ON b.r = a.r AND b.c = a.c - 2 + k.i GROUP BY a.r, a.c")(
    lambda e: nn.conv1d_causal(structure.reshape(e, (1, *e.shape)), generate(e.spark, (e.shape[0], 1, 3), lambda p: p % 3 + 1), groups=e.shape[0]).map(lambda v: F.round(v, 5))
)
_shape(
    "conv2d",
    f"SELECT y * 32 + x AS pos, round(sum(v * (1 + 3 * i + j)), 5) + 0.0 AS v FROM (SELECT (r + 1 - i) // 2 AS y, (c + 1 - j) // 2 AS x, i, j, v FROM e, {upto(3, 'i')}, {upto(3, 'j')} WHERE (r + 1 - i) % 2 = 0 AND (c + 1 - j) % 2 = 0) WHERE y >= 0 AND y <= ({N} - 1) // 2 AND x >= 0 AND x < 32 GROUP BY y, x",
)(lambda e: nn.conv(_image(e), generate(e.spark, (1, 1, 3, 3), lambda p: p + 1), stride=[2, 2], padding=[1, 1]).map(lambda v: F.round(v, 5)))
_shape("interpolate_nearest", f"SELECT y * 64 + c AS pos, round(v, 6) + 0.0 AS v FROM {upto(f'{N} * 2', 'y')}, e WHERE r = y // 2")(lambda e: nn.interpolate(_image(e), [2, 1]))
_shape(
    "interpolate_linear",
    f"SELECT y * 64 + a.c AS pos, round(a.v * (1 - f) + b.v * f, 6) + 0.0 AS v FROM (SELECT y, least(floor(s), {N} - 1) AS lo, least(floor(s) + 1, {N} - 1) AS hi, s - floor(s) AS f FROM (SELECT y, greatest((y + 0.5) / 2 - 0.5, 0) AS s FROM {upto(f'{N} * 2', 'y')})) JOIN e a ON a.r = lo JOIN e b ON b.r = hi AND b.c = a.c",
)(lambda e: nn.interpolate(_image(e), [2, 1], "linear"))


@query(
    "ssm_scan",
    f"""WITH RECURSIVE e AS MATERIALIZED ({E_SQL}), h AS (
      SELECT r, 0 AS t, 0.1 * v * v AS h, v FROM e WHERE c = 0
      UNION ALL SELECT e.r, e.c, exp(-0.05) * h.h + 0.1 * e.v * e.v, e.v FROM h JOIN e ON e.r = h.r AND e.c = h.t + 1)
    SELECT r * 64 + t AS pos, round(h * v + 0.5 * v, 5) + 0.0 AS v FROM h""",
)
def _ssm(spark, sf_dir):
    e = vectors(spark, sf_dir)
    e = structure.reshape(e, (e.shape[0], 1, WIDTH))
    step = e.map(lambda v: F.lit(0.1))
    d = literal(spark, [0.5])
    return tidy(nn.ssm_scan(e, step, literal(spark, [[-0.5]]), e, e, d), 5)


@query(
    "scan_decay",
    """WITH RECURSIVE x AS MATERIALIZED (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
    h AS (SELECT user_id, t, value AS h FROM x WHERE t = 0 UNION ALL SELECT x.user_id, x.t, 0.9 * h.h + x.value FROM h JOIN x ON x.user_id = h.user_id AND x.t = h.t + 1)
    SELECT user_id, t, round(h, 4) AS h FROM h""",
)
def _decay(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, sf_dir, "events").withColumn("t", (F.row_number().over(order) - 1).cast("long"))
    most = 1 << 20
    x = from_cells(rows.select((F.col("user_id") * most + F.col("t")).alias("pos"), F.col("value").alias("v")), (1 << 30, most))
    out = windowed.scan_sum(x, 0.9).cells()
    return out.select(F.expr(f"pos div {most}L").alias("user_id"), (F.col("pos") % most).alias("t"), F.round("v", 4).alias("h"))


# -- graph messages: suppliers of parts ---------------------------------------------------


@query("gnn_message", f"WITH e AS ({E_SQL}), g AS (SELECT r AS s, (r * 3) % {N} AS d FROM (SELECT DISTINCT r FROM e) UNION ALL SELECT r, r % 5 + 10 FROM (SELECT DISTINCT r FROM e)) SELECT e.r * 64 + e.c AS pos, round(coalesce(sum(u.v), 0), 5) + 0.0 AS v FROM e LEFT JOIN g ON g.d = e.r LEFT JOIN e u ON u.r = g.s AND u.c = e.c GROUP BY e.r, e.c")
def _gnn(spark, sf_dir):
    """Two edges from each row; five rows take an edge from every fifth row each."""
    e = vectors(spark, sf_dir)
    ids = spark.range(e.shape[0]).select(F.col("id").alias("src"))
    edges = ids.withColumn("dst", (F.col("src") * 3) % e.shape[0]).unionByName(ids.withColumn("dst", F.col("src") % 5 + 10))
    return tidy(nn.gnn_message(e, edges), 5)


# -- quantization and sparse forms -------------------------------------------------------

_BLK = f"WITH e AS ({E_SQL}), b AS (SELECT *, c // 16 AS k, min(v) OVER w AS lo, max(v) OVER w AS hi, max(abs(v)) OVER w AS top FROM e WINDOW w AS (PARTITION BY r, c // 16))"
_SYM = quant.Scheme("sym", "i8", (1, 16))
_AFF = quant.Scheme("affine-sub", "u8", (1, 16))


@query("q_sym_block", f"{_BLK} SELECT r * 64 + c AS pos, least(greatest(round_even(v / CASE WHEN top = 0 THEN 1 ELSE top / 127 END, 0), -128), 127) + 0.0 AS v FROM b")
def _qsym(spark, sf_dir):
    return tidy(quant.quantize(vectors(spark, sf_dir), _SYM)[0])


@query("q_affine_block", f"{_BLK}, s AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (hi - lo) / 255 END AS s FROM b) SELECT r * 64 + c AS pos, least(greatest(round_even(v / s + round_even(0 - lo / s, 0), 0), 0), 255) + 0.0 AS v FROM s")
def _qaff(spark, sf_dir):
    return tidy(quant.quantize(vectors(spark, sf_dir), _AFF)[0])


@query("dq_affine_block", f"{_BLK}, s AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (hi - lo) / 255 END AS s FROM b), z AS (SELECT *, round_even(0 - lo / s, 0) AS z FROM s) SELECT r * 64 + c AS pos, round((least(greatest(round_even(v / s + z, 0), 0), 255) - z) * s, 6) + 0.0 AS v FROM z")
def _dqaff(spark, sf_dir):
    q, s, z = quant.quantize(vectors(spark, sf_dir), _AFF)
    return tidy(quant.dequantize(q, _AFF, scale=s, zero=z))


@query("fake_quant", f"{_BLK}, s AS (SELECT *, CASE WHEN top = 0 THEN 1 ELSE top / 127 END AS s FROM b) SELECT r * 64 + c AS pos, round(least(greatest(round_even(v / s, 0), -128), 127) * s, 6) + 0.0 AS v FROM s")
def _fake(spark, sf_dir):
    return tidy(quant.fake_quant(vectors(spark, sf_dir), _SYM))


@query("qmatmul", f"WITH e AS ({E_SQL}) SELECT a.r * {N} + b.r AS pos, round(sum(round_even(a.v * 10, 0) * 0.1 * b.v), 5) + 0.0 AS v FROM e a JOIN e b ON a.c = b.c GROUP BY ALL")
def _qmm(spark, sf_dir):
    e = vectors(spark, sf_dir)
    q = elementwise.cast(e.map(lambda v: v * 10), "i8")
    return tidy(quant.qmatmul(q, structure.transpose(e), quant.Scheme("sym", "i8"), scale=literal(spark, [[0.1]])), 5)


_TRIES = ", ".join(f"({k}, CAST({r} AS DOUBLE))" for k, r in enumerate(quant.CLIP_RATIOS))


@query(
    "requant_grid",
    f"""WITH e AS ({E_SQL}), b AS (SELECT *, r * 4 + c // 16 AS blk FROM e), t AS (SELECT blk, max(abs(v)) AS top FROM b GROUP BY blk),
    s AS (SELECT blk, turn, ratio, CAST(CAST(CASE WHEN top = 0 THEN 1 ELSE top * ratio / 7 END AS FLOAT) AS DOUBLE) AS s FROM t, (VALUES {_TRIES}) AS g(turn, ratio)),
    x AS (SELECT s.blk, turn, ratio, s, sum(pow(least(greatest(round_even(v / s, 0), -7), 7) * s - v, 2)) AS cost FROM b JOIN s ON s.blk = b.blk GROUP BY ALL)
    SELECT blk, arg_min(ratio, (cost, turn)) AS ratio, round(arg_min(s, (cost, turn)), 6) AS s, round(min(cost), 6) AS cost FROM x GROUP BY blk""",
)
def _requant(spark, sf_dir):
    got = quant.requantize(vectors(spark, sf_dir), 4, 16)
    return got.select("blk", "ratio", F.round("s", 6).alias("s"), F.round("cost", 6).alias("cost"))


@query("codebook_nearest", f"WITH e AS ({E_SQL}), b AS (SELECT k, v FROM (VALUES {', '.join(f'({k}, CAST({v!r} AS DOUBLE))' for k, v in enumerate(quant.normal_float(4)))}) AS g(k, v)) SELECT e.r * 64 + e.c AS pos, CAST(arg_min(k, (abs(b.v - e.v), k)) AS DOUBLE) AS v FROM e, b GROUP BY e.r, e.c")
def _nearest(spark, sf_dir):
    return tidy(quant.codebook_nearest(vectors(spark, sf_dir), literal(spark, quant.normal_float(4))))


@query("dq_codebook", f"WITH e AS ({E_SQL}), b AS (SELECT k, v FROM (VALUES {', '.join(f'({k}, CAST({v!r} AS DOUBLE))' for k, v in enumerate(quant.normal_float(4)))}) AS g(k, v)) SELECT e.r * 64 + e.c AS pos, round(b.v * 2, 6) + 0.0 AS v FROM e JOIN b ON b.k = (e.r + e.c) % 16")
def _dqbook(spark, sf_dir):
    q = generate(spark, vectors(spark, sf_dir).shape, lambda p: (F.expr("pos div 64L") + p % 64) % 16, "u8")
    scheme = quant.Scheme("codebook", "u8")
    return tidy(quant.dequantize(q, scheme, scale=literal(spark, [[2.0]]), book=literal(spark, quant.normal_float(4))))


@query("unpack_awq", "SELECT o_orderkey * 8 + k AS pos, CAST((CAST(o_custkey * 2654435 % 2147483647 AS BIGINT) >> (4 * [0, 4, 1, 5, 2, 6, 3, 7][k + 1])) & 15 AS DOUBLE) AS v FROM orders, generate_series(0, 7) AS g(k)")
def _awq(spark, sf_dir):
    words = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 2654435 % 2147483647).alias("w"))
    return quant.unpack_words(words, 4, order=quant.AWQ_ORDER)


@query("effective_bits", "SELECT p_brand AS brand, CAST(sum(p_size) * 8 AS DOUBLE) / sum(length(p_name)) AS bits FROM part GROUP BY 1")
def _bits(spark, sf_dir):
    rows = load(spark, sf_dir, "part").withColumn("n", F.char_length("p_name"))
    return rows.groupBy(F.col("p_brand").alias("brand")).agg(reduce.effective_bits(rows, "p_size", "n").alias("bits"))


#: Columns of the parts as a sparse matrix: a part's price stands in the column of its size (1 to 50).
SIZES = 51


@dataclass(frozen=True)
class _Parts:
    """The parts in order of key: their number, columns and prices."""

    spark: SparkSession
    df: DataFrame
    n: int

    def tensor(self, pos, v, shape) -> TensorRef:
        return from_cells(self.df.select(pos.cast("long").alias("pos"), v.cast("double").alias("v")), shape)

    @property
    def shape(self) -> tuple[int, int]:
        return self.n, SIZES

    @property
    def columns(self) -> TensorRef:
        return self.tensor(F.col("r"), F.col("s"), (self.n,))

    @property
    def prices(self) -> TensorRef:
        return self.tensor(F.col("r"), F.col("p"), (self.n,))

    @property
    def mask(self) -> TensorRef:
        on = self.df.select((F.col("r") * SIZES + F.col("s")).alias("pos"), F.lit(1.0).alias("v"))
        grid = self.spark.range(self.n * SIZES).select(F.col("id").alias("pos"))
        return from_cells(grid.join(on, "pos", "left").select("pos", F.coalesce("v", F.lit(0.0)).alias("v")), self.shape)

    def blocks(self, wide: int) -> TensorRef:
        """Each price in a block of its own, of one row and ``wide`` columns."""
        each = F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("o")
        cells = self.df.select("r", "s", "p", each)
        value = F.when(F.col("o") == F.col("s") % wide, F.col("p")).otherwise(0.0)
        return from_cells(cells.select((F.col("r") * wide + F.col("o")).alias("pos"), value.alias("v")), (self.n, 1, wide))


def _sparse(name: str, fill: float = 0.0, width: int = SIZES, column: str = "p_size", rows: str = "(SELECT count(*) FROM part)"):
    def keep(f):
        def run(spark, sf_dir):
            part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("r"), F.col("p_size").cast("long").alias("s"), F.col("p_retailprice").alias("p"))
            return tidy(f(_Parts(spark, part, part.count())))

        return query(name, f"SELECT i * {width} + j AS pos, round(coalesce(p_retailprice, {fill}), 6) + 0.0 AS v FROM {upto(rows, 'i')} CROSS JOIN {upto(width, 'j')} LEFT JOIN part ON p_partkey = i AND {column} = j")(run)

    return keep


@_sparse("sparse_coo")
def _coo(t: _Parts) -> TensorRef:
    places = t.df.select("r", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("r").alias("i")), F.struct(F.lit(1).alias("k"), F.col("s").alias("i")))).alias("e"))
    index = from_cells(places.select((F.col("e.k") * t.n + F.col("r")).alias("pos"), F.col("e.i").alias("v")), (2, t.n))
    return sparse.coo(index, t.prices, t.shape)


@_sparse("sparse_csr")
def _csr(t: _Parts) -> TensorRef:
    return sparse.csr(arange(t.spark, t.n + 1), t.columns, t.prices, t.shape)


@_sparse("sparse_csc")
def _csc(t: _Parts) -> TensorRef:
    """Entries by column: a column begins after all entries of the columns before it."""
    counts = t.df.groupBy("s").count().collect()  # fifty rows
    sizes = [0] * SIZES
    for r in counts:
        sizes[r.s] = r["count"]
    begins = list(itertools.accumulate(sizes, initial=0))
    first = F.element_at(F.array(*(F.lit(x) for x in begins)), (F.col("s") + 1).cast("int"))
    at = first + F.row_number().over(Window.partitionBy("s").orderBy("r")) - 1
    placed = _Parts(t.spark, t.df.withColumn("k", at), t.n)
    rows, prices = (placed.tensor(F.col("k"), F.col(c), (t.n,)) for c in ("r", "p"))
    return sparse.csc(literal(t.spark, begins), rows, prices, t.shape)


@_sparse("sparse_bsr")
def _bsr(t: _Parts) -> TensorRef:
    return sparse.bsr(arange(t.spark, t.n + 1), t.tensor(F.col("r"), F.floor(F.col("s") / 3), (t.n,)), t.blocks(3), (1, 3), t.shape)


@_sparse("sparse_blocklist")
def _blocklist(t: _Parts) -> TensorRef:
    return sparse.blocklist(t.tensor(F.col("r"), F.col("r") * 17 + F.floor(F.col("s") / 3), (t.n,)), t.blocks(3), (1, 3), t.shape)


@_sparse("sparse_bitmask")
def _bitmask(t: _Parts) -> TensorRef:
    return sparse.bitmask(t.mask, t.prices, t.shape)


@_sparse("sparse_nm", fill=-1.0)
def _nm(t: _Parts) -> TensorRef:
    return sparse.nm(t.mask, t.prices, t.shape, 1, SIZES, -1.0)


@_sparse("sparse_ragged", fill=9.0, width=3, column="0")
def _ragged(t: _Parts) -> TensorRef:
    return sparse.ragged(arange(t.spark, t.n + 1), t.prices, (t.n, 3), 9.0)


_STEP = "pow(2.0, floor(log2(abs(v))) - 7)"


@query("round_modes", f"SELECT pos, trunc(v / {_STEP}) * {_STEP} AS rtz, ceil(v / {_STEP}) * {_STEP} AS rup, floor(v / {_STEP}) * {_STEP} AS rdown FROM (SELECT l_orderkey * 8 + l_linenumber AS pos, l_extendedprice AS v FROM lineitem)")
def _modes(spark, sf_dir):
    return lines(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), *(round_through(F.col("l_extendedprice"), "bf16", m).alias(m) for m in ("rtz", "rup", "rdown")))
