"""Queries of control flow, quantization formulas, adapters, layouts, codecs, files, templates and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import codecs, layouts, template, tokenizer
from ..functions.dtypes import fixed
from ..functions.rows import small_batches
from ..operators import elementwise, merge, objects, quant, reduce, structure
from ..plans import expr as E
from ..plans import graph as G
from ..scratch import fresh
from ..sources import files, packed, stores
from ..tensor import TensorRef, from_arrays, full, generate, literal, ones, zeros
from .tensors import E_SQL, N, WIDTH, lines, load, tidy, upto, vectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _shape(name: str, sql: str):
    """A query over the cells of E."""

    def keep(f):
        return query(name, f"WITH e AS ({E_SQL}) {sql}")(lambda s, d: tidy(f(vectors(s, d))))

    return keep


_CELL = "SELECT r * 64 + c AS pos, round({v}, 6) + 0.0 AS v FROM e"

# -- sources of tensors ---------------------------------------------------------------------

_shape("full_add", _CELL.format(v="v + 2.5"))(lambda e: elementwise.add(e, full(e.spark, e.shape, 2.5)))
_shape("ones_sub", _CELL.format(v="1 - v"))(lambda e: elementwise.sub(ones(e.spark, e.shape), e))
_shape("zeros_max", _CELL.format(v="greatest(v, 0)"))(lambda e: elementwise.maximum(zeros(e.spark, e.shape), e))


@query("from_arrays", f"WITH e AS ({E_SQL}) {_CELL.format(v='v')}")
def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "embeddings")
    return tidy(from_arrays(df, F.col("vec_id"), "embedding", df.count(), WIDTH))


# -- elementwise and casts --------------------------------------------------------------------

_ERF = "1.1283791670955126 * list_sum(list_transform(generate_series(0, 12), lambda n: pow(-1, n) * pow({x}, 2 * n + 1) / (factorial(CAST(n AS INTEGER)) * (2 * n + 1))))"


def _line(name: str, sql: str):
    def keep(f):
        def run(spark, sf_dir):
            df = lines(spark, sf_dir).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), *(F.col(f"l_{c}").alias(c) for c in ("extendedprice", "quantity", "discount")))
            t = {c: TensorRef(df, (1 << 40,), F.col(c), literal(spark, 0).dtype) for c in ("extendedprice", "quantity", "discount")}
            return tidy(f(t))

        return query(name, f"SELECT l_orderkey * 8 + l_linenumber AS pos, round({sql}, 6) + 0.0 AS v FROM lineitem")(run)

    return keep


_line("ew_erf", _ERF.format(x="l_discount"))(lambda t: elementwise.unary("erf", t["discount"]))
_line("act_gelu", f"0.5 * l_discount * (1 + {_ERF.format(x='(l_discount / sqrt(2))')})")(lambda t: elementwise.activation("gelu", t["discount"]))
_line("act_tanh", "(exp(2 * l_discount) - 1) / (exp(2 * l_discount) + 1)")(lambda t: elementwise.activation("tanh", t["discount"]))
_line("ew_abs", "abs(l_discount - 0.05)")(lambda t: elementwise.unary("abs", t["discount"].map(lambda v: v - 0.05)))
_line("cast_bool", "CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END")(lambda t: elementwise.cast(t["discount"], "bool"))
_line("cast_fixed", "least(greatest(round_even(l_quantity * 16, 0) / 16, -8), 127.0 / 16)")(lambda t: elementwise.cast(t["quantity"], fixed(8, 4)))
_line("cast_e8m0", "pow(2.0, floor(log2(l_quantity)))")(lambda t: elementwise.cast(t["quantity"], "e8m0"))
_line("cast_ternary", "least(greatest(round_even(l_quantity - 2, 0), -1), 1)")(lambda t: elementwise.cast(t["quantity"].map(lambda v: v - 2), "ternary"))
_line("cast_u8", "least(greatest(round_even(l_extendedprice / 100, 0), 0), 255)")(lambda t: elementwise.cast(t["extendedprice"].map(lambda v: v / 100), "u8"))
_line("approx", "l_quantity")(lambda t: elementwise.approx(t["quantity"], 0.1))

_shape("sum_sequential", "SELECT r AS pos, round(sum(v), 6) + 0.0 AS v FROM e GROUP BY r")(lambda e: reduce.reduce(e, "sum", [1], order="sequential"))
_shape("sum_pairwise", "SELECT r AS pos, round(sum(v), 6) + 0.0 AS v FROM e GROUP BY r")(lambda e: reduce.reduce(e, "sum", [1], order="pairwise"))
_shape("relayout", _CELL.format(v="v"))(lambda e: structure.relayout(e, "col-major"))
_shape("flat_params", "SELECT r * 64 + c - 64 AS pos, round(v, 6) + 0.0 AS v FROM e WHERE r >= 1")(lambda e: structure.flat_slice(structure.reshape(e, (-1,)), 64, (e.shape[0] - 1, 64)))


# -- control flow -------------------------------------------------------------------------------


def _run(e: TensorRef, *ops: G.Op, functions: dict | None = None) -> G.Outcome:
    module = G.Module({"main": G.Function("main", ("x",), ops), **(functions or {})})
    assert not G.verify(module), G.verify(module)
    return G.run(module, [e])


def _yield(*ops: G.Op, result: str, params: tuple = ()) -> G.Function:
    return G.Function("", params, (*ops, G.Op("core.yield", (result,))))


_DONE = G.Op("core.return", ("y",))
_shape("graph_if", "SELECT r * 64 + c AS pos, round(CASE WHEN t > 0 THEN v + v ELSE -v END, 6) + 0.0 AS v FROM e, (SELECT sum(v) AS t FROM e)")(
    lambda e: _run(
        e,
        G.Op("tensor.reduce", ("x",), ("s",), {"kind": "sum", "axes": [0, 1]}),
        G.Op("nn.activation", ("s",), ("t",), {"kind": "relu"}),
        G.Op("core.if", ("t",), ("y",), {}, (_yield(G.Op("tensor.add", ("x", "x"), ("a",)), result="a"), _yield(G.Op("tensor.neg", ("x",), ("b",)), result="b"))),
        _DONE,
    ).results[0]
)
_shape("graph_call", _CELL.format(v="4 * v"))(
    lambda e: _run(
        e,
        G.Op("core.call", ("x",), ("t",), {"callee": "twice"}),
        G.Op("core.call", ("t",), ("y",), {"callee": "twice"}),
        _DONE,
        functions={"twice": G.Function("twice", ("a",), (G.Op("tensor.add", ("a", "a"), ("b",)), G.Op("core.return", ("b",))))},
    ).results[0]
)
_shape("graph_region", _CELL.format(v="v - 1"))(
    lambda e: _run(e, G.Op("core.region", ("x",), ("y",), {}, (_yield(G.Op("core.constant", (), ("one",), {"value": 1.0}), G.Op("tensor.sub", ("a", "one"), ("b",)), result="b", params=("a",)),)), _DONE).results[0]
)


def _quarters(e: TensorRef) -> TensorRef:
    """E as four slices along the first axis; rows past a multiple of four are left to none, as there are none here."""
    n = e.shape[0] // 4
    return structure.reshape(structure.slice_(e, [0, 0], [4 * n, 64]), (4, n, 64))


_Q = f"({N} // 4)"
_shape("graph_map", f"SELECT r // {_Q} AS pos, round(max(v), 6) + 0.0 AS v FROM e WHERE r < 4 * {_Q} GROUP BY 1")(
    lambda e: _run(_quarters(e), G.Op("core.map", ("x",), ("y",), {"axis": 0}, (_yield(G.Op("tensor.reduce", ("p",), ("m",), {"kind": "max", "axes": [0, 1]}), result="m", params=("p",)),)), _DONE).results[0]
)
_shape("graph_scan", f"SELECT r // {_Q} AS pos, round(sum(sum(v)) OVER (ORDER BY r // {_Q}), 5) + 0.0 AS v FROM e WHERE r < 4 * {_Q} GROUP BY 1")(
    lambda e: _run(
        _quarters(e),
        G.Op("core.constant", (), ("zero",), {"value": 0.0}),
        G.Op("core.scan", ("zero", "x"), ("last", "y"), {"axis": 0}, (G.Function("", ("h", "p"), (G.Op("tensor.reduce", ("p",), ("s",), {"kind": "sum", "axes": [0, 1]}), G.Op("tensor.add", ("h", "s"), ("t",)), G.Op("core.yield", ("t", "t")))),)),
        _DONE,
    ).results[0].map(lambda v: F.round(v, 5))
)
_shape("graph_tuple", _CELL.format(v="-v"))(
    lambda e: _run(e, G.Op("tensor.neg", ("x",), ("n",)), G.Op("core.tuple", ("x", "n"), ("t",)), G.Op("core.get", ("t",), ("y",), {"index": 1}), _DONE).results[0]
)
_shape("graph_output", _CELL.format(v="exp(v)"))(
    lambda e: _run(
        e,
        G.Op("core.constant", (), ("ok",), {"value": 1.0}),
        G.Op("core.assert", ("ok",), (), {"message": "never"}),
        G.Op("tensor.exp", ("x",), ("y",)),
        G.Op("core.debug", ("y",), (), {"label": "seen"}),
        G.Op("io.output", ("y",), (), {"name": "out"}),
        _DONE,
    ).outputs["out"]
)


@query("graph_print", "SELECT * FROM (VALUES ('func main(x) {'), ('  y = tensor.exp(x)'), ('  core.return(y)'), ('}')) AS t(line)")
def _print(spark, sf_dir):
    text = G.show(G.Module({"main": G.Function("main", ("x",), (G.Op("tensor.exp", ("x",), ("y",)), _DONE))}))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


@query("graph_migrate", "SELECT 'nn.attention' AS op, 2 AS version, 1 AS applied")
def _migrate(spark, sf_dir):
    old = G.Module({"main": G.Function("main", ("q",), (G.Op("nn.attention", ("q", "q", "q"), ("y",)), _DONE))})
    new, n = G.rewrite(old, G.MIGRATIONS)
    return spark.createDataFrame([(op.name, op.version, n) for op in new.functions["main"].body[:1]], "op string, version int, applied int")


# -- quantization ----------------------------------------------------------------------------------

_BLK = f"WITH e AS ({E_SQL}), b AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM e WINDOW w AS (PARTITION BY r, c // 16)), s AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (hi - lo) / 255 END AS s FROM b)"


@query("dq_affine_add", f"{_BLK} SELECT r * 64 + c AS pos, round(least(greatest(round_even((v - lo) / s, 0), 0), 255) * s + lo, 6) + 0.0 AS v FROM s")
def _added(spark, sf_dir):
    scheme = quant.Scheme("affine-add", "u8", (1, 16))
    q, s, z = quant.quantize(vectors(spark, sf_dir), scheme)
    return tidy(quant.dequantize(q, scheme, scale=s, zero=z))


def _whole(e: TensorRef) -> TensorRef:
    return elementwise.cast(e.map(lambda v: v * 10), "i8")


_INT = "least(greatest(round_even(v * 10, 0), -128), 127)"
_shape("dq_nested", _CELL.format(v=f"({_INT} - 1) * ((0.5 - 0.25) * 2)"))(
    lambda e: quant.dequantize(_whole(e), quant.Scheme("nested"), scale=literal(e.spark, [[0.5]]), zero=literal(e.spark, [[1.0]]), scale_scale=literal(e.spark, [[2.0]]), scale_zero=literal(e.spark, [[0.25]]))
)
_shape("dq_clip", _CELL.format(v=f"least(greatest({_INT} * 0.25, -0.3), 0.3)"))(lambda e: quant.dequantize(_whole(e), quant.Scheme("sym", clip=(-0.3, 0.3)), scale=literal(e.spark, [[0.25]])))
_shape("dq_order", f"SELECT ({N} - 1 - r) * 64 + c AS pos, round({_INT} * 0.25, 6) + 0.0 AS v FROM e")(
    lambda e: quant.dequantize(_whole(e), quant.Scheme("sym", order=tuple(range(e.shape[0] - 1, -1, -1))), scale=literal(e.spark, [[0.25]]))
)
_shape("dq_codebook_raw", "SELECT r * 64 + c AS pos, CAST(((r + c) % 4) * 1.5 AS DOUBLE) AS v FROM e")(
    lambda e: quant.dequantize(generate(e.spark, e.shape, lambda p: (F.expr("pos div 64L") + p % 64) % 4, "u8"), quant.Scheme("codebook-raw", "u8"), book=literal(e.spark, [0.0, 1.5, 3.0, 4.5]))
)
_shape("fake_quant_given", _CELL.format(v="least(greatest(round_even(v / 0.02, 0), -128), 127) * 0.02"))(lambda e: quant.fake_quant(e, quant.Scheme("sym"), scale=literal(e.spark, [[0.02]])))
_shape("unpack_int8_rows", "SELECT r * 64 + c AS pos, round(least(greatest(round_even(v * 100, 0), -128), 127) * (r % 3 + 1) / 127, 6) + 0.0 AS v FROM e")(
    lambda e: packed.int8_rows(elementwise.cast(e.map(lambda v: v * 100), "i8"), generate(e.spark, (e.shape[0],), lambda p: p % 3 + 1))
)
_FP4 = ", ".join(map(repr, packed.FP4))
_shape("unpack_fp4", f"SELECT r * 64 + c AS pos, round(list_extract(CAST([{_FP4}] AS DOUBLE[]), CAST((r * 64 + c) % 16 + 1 AS BIGINT)) * 0.5, 6) + 0.0 AS v FROM e")(
    lambda e: packed.fp4(generate(e.spark, (e.shape[0] * 32,), lambda p: ((p * 2) % 16) * 16 + (p * 2 + 1) % 16), generate(e.spark, (e.shape[0],), lambda p: F.lit(0.5)), e.shape, block=64)
)
_shape("unpack_nested_scales", "SELECT r * 64 + c AS pos, round(v * (((r % 4) / 4.0) * 2.0 + 0.125), 6) + 0.0 AS v FROM e")(
    lambda e: elementwise.mul(e, structure.reshape(packed.nested_scales(generate(e.spark, (e.shape[0],), lambda p: p % 4, "u8"), literal(e.spark, [0.0, 0.25, 0.5, 0.75]), full(e.spark, (-(-e.shape[0] // 256),), 2.0), 0.125), (-1, 1)))
)


@query("pack_words", "SELECT o_orderkey AS pos, CAST(o_custkey % 16 + 16 * (o_orderkey % 16) + 256 * (o_custkey % 7) AS BIGINT) AS w FROM orders")
def _packing(spark, sf_dir):
    """Eight four-bit fields of each order, five of them zero, as one word."""
    o = load(spark, sf_dir, "orders")
    fields = F.array(F.col("o_custkey") % 16, F.col("o_orderkey") % 16, F.col("o_custkey") % 7, *[F.lit(0)] * 5)
    rows = o.select(F.col("o_orderkey").alias("k"), F.posexplode(fields).alias("at", "v"))
    return quant.pack_words(rows.select((F.col("k") * 8 + F.col("at")).alias("pos"), "v"), 4).select("pos", "w")


@query("quant_histogram", "SELECT p_brand AS quantization, count(*) AS tensors, CAST(sum(p_size) AS BIGINT) AS elements FROM part GROUP BY 1")
def _histogram(spark, sf_dir):
    return quant.histogram(load(spark, sf_dir, "part").select(F.col("p_brand").alias("quantization"), F.col("p_size").cast("long").alias("elements")))


# -- adapters -----------------------------------------------------------------------------------------


def _parts(e: TensorRef) -> dict[str, TensorRef]:
    """Two left and two right factors of rank four, from E itself."""
    n = e.shape[0]
    return {"a1": structure.slice_(e, [0, 0], [4, 64]), "a2": structure.slice_(e, [4, 0], [8, 64]), "b1": structure.slice_(e, [0, 0], [n, 4]), "b2": structure.slice_(e, [0, 4], [n, 8])}


_LOW = "SELECT e.r * 64 + e.c AS pos, round({v}, 5) + 0.0 AS v FROM e JOIN (SELECT b.r, a.c, sum({term}) AS d FROM e a JOIN e b ON b.c = a.r AND a.r < 4 AND b.c < 4 {more} GROUP BY ALL) d USING (r, c)"


def _adapted(name: str, sql: str):
    def keep(f):
        return query(name, f"WITH e AS ({E_SQL}) {sql}")(lambda s, d: tidy(f(vectors(s, d)), 5))

    return keep


_adapted("adalora_apply", _LOW.format(v="e.v + d", term="a.v * b.v * l.v", more="JOIN e l ON l.r = 0 AND l.c = a.r"))(
    lambda e: merge.adalora(e, _parts(e)["b1"], structure.reshape(structure.slice_(e, [0, 0], [1, 4]), (4,)), _parts(e)["a1"])
)
_adapted("vera_apply", _LOW.format(v="e.v + d * 0.5", term="a.v * b.v * l.v", more="JOIN e l ON l.r = 1 AND l.c = a.r"))(
    lambda e: merge.vera(e, _parts(e)["a1"], _parts(e)["b1"], structure.reshape(structure.slice_(e, [1, 0], [2, 4]), (4,)), full(e.spark, (e.shape[0],), 0.5))
)
_adapted(
    "loha_apply",
    "SELECT e.r * 64 + e.c AS pos, round(e.v + 2 * x.d * y.d, 5) + 0.0 AS v FROM e JOIN (SELECT b.r, a.c, sum(a.v * b.v) AS d FROM e a JOIN e b ON b.c = a.r AND a.r < 4 GROUP BY ALL) x USING (r, c) JOIN (SELECT b.r, a.c, sum(a.v * b.v) AS d FROM e a JOIN e b ON b.c = a.r AND a.r >= 4 AND a.r < 8 GROUP BY ALL) y USING (r, c)",
)(lambda e: merge.loha(e, _parts(e)["a1"], _parts(e)["b1"], _parts(e)["a2"], _parts(e)["b2"], 8, 4))
_adapted("bitfit_apply", "SELECT a.r * 64 + a.c AS pos, round(a.v + b.v, 5) + 0.0 AS v FROM e a JOIN e b ON b.r = 2 AND b.c = a.c")(lambda e: merge.bitfit(e, structure.reshape(structure.slice_(e, [2, 0], [3, 64]), (64,))))
_adapted("control_vector", "SELECT a.r * 64 + a.c AS pos, round(a.v + 0.75 * b.v, 5) + 0.0 AS v FROM e a JOIN e b ON b.r = 3 AND b.c = a.c")(lambda e: merge.control_vector(e, structure.slice_(e, [3, 0], [4, 64]), 0.75))
_adapted("compose_sequential", "SELECT a.r * 64 + a.c AS pos, round((a.v + b.v) * a2.v, 5) + 0.0 AS v FROM e a JOIN e b ON b.r = 2 AND b.c = a.c JOIN e a2 ON a2.r = a.r AND a2.c = 0")(
    lambda e: merge.compose_sequential(e, [lambda t: merge.bitfit(t, structure.reshape(structure.slice_(e, [2, 0], [3, 64]), (64,))), lambda t: merge.ia3(t, structure.reshape(structure.slice_(e, [0, 0], [e.shape[0], 1]), (-1,)))])
)

# -- layouts ----------------------------------------------------------------------------------------------


def _placed(name: str, layout, to: str, sql: str):
    def run(spark, sf_dir):
        e = vectors(spark, sf_dir)
        return e.cells().select("pos", layouts.bit_offset(layout(e.shape), e.shape, to, F.col("pos")).alias("bit"))

    query(name, f"SELECT r * 64 + c AS pos, CAST({sql} AS BIGINT) AS bit FROM (SELECT r, c FROM {upto(N, 'r')}, {upto(64, 'c')})")(run)


_L = layouts.Layout
_placed("layout_strided", lambda s: _L(steps=(130, 2), offset=5), "f32", "(r * 130 + c * 2 + 5) * 32")
_placed("layout_column_major", lambda s: _L(order="col-major"), "f16", f"(c * {N} + r) * 16")
_placed("layout_tiled", lambda s: _L("tiled", block=(8, 16), inner="col-major"), "i8", "(((r // 8) * 4 + c // 16) * 128 + (c % 16) * 8 + r % 8) * 8")
_placed("layout_packed", lambda s: _L("packed", per_word=8, word_bits=32, low_first=False), "i4", "((r * 64 + c) // 8) * 32 + 32 - ((r * 64 + c) % 8 + 1) * 4")
_placed("layout_scales_inline", lambda s: _L("blocked-scaled", block=(1, 32), scale="f16", scales="scales-inline"), "i4", "(r * 2 + c // 32) * (128 + 16) + 16 + (c % 32) * 4")
_placed("layout_scales_before", lambda s: _L("blocked-scaled", block=(1, 32), scale="f16", scales="scales-before"), "i4", f"{N} * 2 * 16 + (r * 2 + c // 32) * 128 + (c % 32) * 4")


@query("layout_check", "SELECT * FROM (VALUES ('a', 'valid'), ('b', 'invalid'), ('c', 'indeterminate'), ('d', 'invalid')) AS t(name, status)")
def _layouts(spark, sf_dir):
    given = {"a": (_L(), (4, 6), "f32"), "b": (_L(steps=(2, 1)), (4, 6), "f32"), "c": (_L("opaque"), (4, 6), "f32"), "d": (_L("packed", per_word=3, word_bits=8), (4, 6), "i4")}
    return layouts.check(spark, given).select("name", "status")


# -- codecs and digests ---------------------------------------------------------------------------------------


def _texts(spark, sf_dir):
    return load(small_batches(spark), sf_dir, "documents")


for _codec in ("zlib", "lzma", "zstd"):
    query(f"codec_{_codec}", "SELECT doc_id, sha256(text) AS back FROM documents WHERE text IS NOT NULL")(
        lambda s, d, k=_codec: _texts(s, d).where("text is not null").select("doc_id", F.sha2(codecs.decode(codecs.encode(F.col("text"), k), k), 256).alias("back"))
    )


@query("codec_bitshuffle", "SELECT doc_id, sha256(text) AS back FROM documents WHERE text IS NOT NULL")
def _shuffled(spark, sf_dir):
    there = codecs.bitshuffle(F.col("text"), 4)
    return _texts(spark, sf_dir).where("text is not null").select("doc_id", F.sha2(codecs.bitshuffle(there, 4, back=True), 256).alias("back"))


@query("digest_sha512")
def _sha512(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", codecs.sha512(F.col("text")).alias("digest"), codecs.shake(F.col("text")).alias("shake"))


# -- files and stores --------------------------------------------------------------------------------------------


@query("model_files", f"WITH e AS ({E_SQL}) {_CELL.format(v='v')}")
def _model_files(spark, sf_dir):
    """E written as a model of Parquet blocks and read back."""
    e, place = vectors(spark, sf_dir), fresh(spark, "model")
    files.write_model({"e": e}, place)
    return tidy(files.cells(files.read_model(spark, place), "e", e.shape))


def _through(spark, e: TensorRef, suffix: str) -> DataFrame:
    """E written as a file in the shared folder and read by the reader of its kind."""
    path = f"{fresh(spark, 'file')}/e.{suffix}"
    files.write_file(spark, {"e": e}, path)
    return tidy(files.cells(files.read(spark, path), "e", e.shape))


@query("file_safetensors", f"WITH e AS ({E_SQL}) {_CELL.format(v='v')}")
def _safetensors(spark, sf_dir):
    return _through(spark, vectors(spark, sf_dir), "safetensors")


@query("file_npy", f"WITH e AS ({E_SQL}) {_CELL.format(v='v')}")
def _npy(spark, sf_dir):
    return _through(spark, vectors(spark, sf_dir), "npy")


@query("file_npz", f"WITH e AS ({E_SQL}) {_CELL.format(v='CAST(CAST(v AS FLOAT) AS DOUBLE)')}")
def _npz(spark, sf_dir):
    return _through(spark, elementwise.cast(vectors(spark, sf_dir), "f32"), "npz")


@query("file_gguf", f"WITH e AS ({E_SQL}) {_CELL.format(v='CAST(CAST(v AS FLOAT) AS DOUBLE)')}")
def _gguf(spark, sf_dir):
    return _through(spark, vectors(spark, sf_dir), "gguf")


@query("pack_store", "SELECT sha256(text) AS digest, max(octet_length(encode(text))) AS logical_len FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _pack(spark, sf_dir):
    place = fresh(spark, "pack")
    stores.write_pack(objects.from_payloads(_texts(spark, sf_dir).where("text is not null"), "text"), place)
    return stores.index(stores.open_pack(spark, place)).select("digest", "logical_len")


@query("fsck", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'renamed' ELSE 'valid' END AS status, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _fsck(spark, sf_dir):
    docs = _texts(spark, sf_dir).where("text is not null")
    body = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = docs.select(objects.digest(F.col("text")).alias("digest"), body.cast("binary").alias("payload"))
    return stores.fsck(rows).groupBy("status").agg(F.count("*").alias("n"))


@query("find_objects", "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE text = (SELECT min(text) FROM documents)")
def _find(spark, sf_dir):
    docs = _texts(spark, sf_dir).where("text is not null")
    least = docs.agg(objects.digest(F.min("text")).alias("d")).first().d
    return stores.find(objects.from_payloads(docs, "text"), [least]).select("digest")


@query("separation_violations", "SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 0")
def _violations(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    src, dst = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    refs = o.select(src.alias("src"), dst.alias("dst"), F.lit(1).alias("otype"))
    parts = o.where("o_custkey % 2 = 0").select(src.alias("digest"), F.lit("inference").alias("part")).distinct().unionByName(o.where("o_orderkey % 3 = 0").select(dst.alias("digest"), F.lit("training").alias("part")))
    return objects.separation_violations(refs, parts, [9]).select("src", "dst")


# -- rules ---------------------------------------------------------------------------------------------------------


@query("rule_stats", "SELECT l_returnflag AS tensor, f AS field, CASE WHEN f = 'max' THEN 'invalid' WHEN f IN ('min', 'nan') THEN 'valid' ELSE 'absent' END AS status FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES ('min'), ('max'), ('mean'), ('absmax'), ('nan'), ('inf'), ('nonzero')) AS t(f)")
def _stats(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_returnflag").alias("tensor"), F.col("l_extendedprice").alias("v"))
    got = reduce.stats(rows, ["tensor"])
    declared = got.select("tensor", "min", (F.col("max") + 1).alias("max"), *(F.lit(None).cast("double").alias(c) for c in ("mean", "absmax")), "nan", *(F.lit(None).cast("double").alias(c) for c in ("inf", "nonzero")))
    return reduce.stats_check(declared, got)


@query("rule_chunk_totals", "SELECT o_custkey AS name, CASE WHEN o_custkey % 3 = 0 THEN 'invalid' ELSE 'valid' END AS status FROM orders GROUP BY 1, 2")
def _totals(spark, sf_dir):
    """Orders as chunks of their customer's tensor, one in three declared wrong."""
    chunks = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderkey") % 100 * 4).alias("length"))
    sums = chunks.groupBy("name").agg(F.sum("length").alias("total"))
    tensors = sums.select("name", F.when(F.col("name") % 3 == 0, F.col("total") + 4).otherwise(F.col("total")).alias("total"), (F.col("total") / 4).alias("elements"), F.lit(32).alias("bits"))
    return rules.chunk_totals(tensors, chunks).select(F.col("name").cast("long").alias("name"), "status")


@query("rule_schemes", "SELECT * FROM (VALUES ('a', 'valid'), ('b', 'invalid'), ('c', 'invalid')) AS t(name, status)")
def _schemes(spark, sf_dir):
    blocks = quant.Scheme("sym", "i8", (1, 16))
    return rules.scheme_shapes(spark, {"a": (blocks, (4, 64), {"scale": (4, 4)}), "b": (blocks, (4, 64), {"scale": (4, 5)}), "c": (quant.Scheme("codebook", "u8"), (4, 64), {"book": (2, 2)})}).select("name", "status")


@query("rule_expressions", "SELECT * FROM (VALUES ('bare', 'R-T05', 'valid'), ('bare', 'R-T06', 'invalid'), ('deep', 'R-T05', 'invalid'), ('deep', 'R-T06', 'indeterminate'), ('marked', 'R-T05', 'valid'), ('marked', 'R-T06', 'valid')) AS t(name, rule, status)")
def _expressions(spark, sf_dir):
    x = E.node("literal", source="x", shape=[4, 16], dtype="f64")
    q = E.node("quantize", x, scheme={"formula": "sym", "q": "i8"})
    deep = x
    for _ in range(300):
        deep = E.Expr("relayout", (deep,), (("layout", "row-major"),))
    given = {"bare": q, "marked": E.Expr("approx", (q,), (("bound", 0.1),)), "deep": deep}
    return rules.expressions(spark, given).select("name", "rule", "status")


@query("rule_metadata", "SELECT p_partkey AS name, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'invalid' ELSE 'valid' END AS status FROM part")
def _metadata(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") % 2 == 0, "rope").otherwise("none").alias("rope_kind"), F.when(F.col("p_size") % 3 != 0, True).alias("interleaved"))
    return rules.metadata(rows).select(F.col("name").cast("long").alias("name"), "status")


@query("rule_vocabulary", "SELECT c_custkey AS name, CASE WHEN n IS NULL THEN 'indeterminate' WHEN n = 10 THEN 'valid' ELSE 'invalid' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _vocabulary(spark, sf_dir):
    sizes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.lit(10).cast("long").alias("vocab"))
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.count("*").alias("rows"))
    return rules.vocabulary(sizes, rows).select(F.col("name").cast("long").alias("name"), "status")


@query("rule_token_vectors", "SELECT event_id AS name, CASE WHEN event_id % 4 = 0 THEN 'invalid' ELSE 'valid' END AS status FROM events")
def _tokens(spark, sf_dir):
    """Bytes of event types as recorded ids, one in four recorded wrong."""
    e = load(spark, sf_dir, "events")
    ids = F.transform(F.split("event_type", ""), lambda c: F.ascii(c))
    rows = e.select(F.col("event_id").alias("name"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 4 == 0, F.array(F.lit(0))).otherwise(ids).alias("ids"))
    return rules.token_vectors(tokenizer.byte_level(), rows).select(F.col("name").cast("long").alias("name"), "status")


@query("rule_template_vectors", "SELECT event_id AS name, CASE WHEN event_id % 4 = 0 THEN 'invalid' ELSE 'valid' END AS status FROM events")
def _templates(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    want = F.when(F.col("event_id") % 4 == 0, "x").otherwise(F.concat(F.lit("<"), F.upper("event_type"), F.lit(">")))
    rows = e.select(F.col("event_id").alias("name"), F.to_json(F.struct(F.col("event_type").alias("t"))).alias("input"), want.alias("rendered"))
    return rules.template_vectors("<{{ t | upper }}>", rows).select(F.col("name").cast("long").alias("name"), "status")


@query("dataloader_position", "SELECT user_id AS worker, count(DISTINCT event_id) AS samples, max(event_id) AS position, count(DISTINCT event_id) // 8 AS batches, count(DISTINCT event_id) % 8 AS rest FROM events GROUP BY 1")
def _loader(spark, sf_dir):
    return rules.dataloader(load(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), F.col("event_id").alias("position")), batch=8)


@query("random_states", "SELECT event_type AS scope, user_id AS worker, max(event_id) AS step, arg_max(value, event_id) AS state FROM events GROUP BY ALL")
def _states(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("user_id").alias("worker"), F.col("event_id").alias("step"), F.col("value").alias("state"))
    return rules.random_states(rows)


@query("training_optimizer", "SELECT o_custkey AS name, count(*) AS moments, CASE WHEN min(o_orderkey % 2) = max(o_orderkey % 2) AND min(o_orderkey % 2) = 1 THEN 'valid' ELSE 'invalid' END AS status FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 0, 'indeterminate' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _optimizer(spark, sf_dir):
    moments = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("moment"), (F.col("o_orderkey") % 2).alias("elements"))
    return rules.optimizer_rows(moments, load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.lit(1).alias("elements")))


@query("plugin_provides", "SELECT p_brand AS ns, p_type AS name, CAST(max(p_size) + p_partkey_ AS INTEGER) AS version, CASE WHEN p_partkey_ = 0 THEN 'served' ELSE 'too old' END AS status FROM part, (VALUES (0), (1)) AS t(p_partkey_) GROUP BY p_brand, p_type, p_partkey_")
def _provides(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    have = p.select(F.col("p_name").alias("plugin"), F.col("p_brand").alias("ns"), F.col("p_type").alias("name"), F.col("p_size").alias("version"))
    newest = p.groupBy(F.col("p_brand").alias("ns"), F.col("p_type").alias("name")).agg(F.max("p_size").alias("top"))
    need = newest.select("ns", "name", F.explode(F.array(F.col("top"), F.col("top") + 1)).alias("version"))
    return rules.provides(have, need).withColumn("version", F.col("version").cast("int"))


# -- template functions and tokenizers ---------------------------------------------------------------------------------


@query("tpl_keys_values", "SELECT event_id, 'k' AS keys, coalesce(json_extract_string(props, '$.k'), 'none') AS vals FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _keys(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    rows = load(spark, sf_dir, "events").select("event_id", props.alias("m")).where(F.col("m")["k"].isNotNull())
    return rows.select("event_id", template.join(template.keys(F.col("m")), ",").alias("keys"), template.join(template.values(F.col("m")), ",").alias("vals"))


@query("tpl_abs_string", "SELECT p_partkey, CAST(abs(p_size - 25) AS VARCHAR) AS s FROM part")
def _abs(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", template.string(template.absolute(F.col("p_size") - 25)).alias("s"))


@query("tpl_tojson", """SELECT p_partkey, '{"n":' || p_size || ',"t":"' || p_type || '"}' AS s FROM part""")
def _tojson(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", template.tojson(F.struct(F.col("p_size").alias("n"), F.col("p_type").alias("t"))).alias("s"))


@query("tpl_operators", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END || CAST(p_size * 2 + 1 AS VARCHAR) AS s FROM part")
def _operators(spark, sf_dir):
    source = "{% if n > 25 %}big{% elif n % 2 == 0 %}even{% else %}odd{% endif %}{{ n * 2 + 1 }}"
    rows = load(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("n"))).alias("i"))
    return rows.select("p_partkey", template.render(source)("i").alias("s"))


@query("tok_decode", "SELECT doc_id, text AS back FROM documents WHERE text IS NOT NULL")
def _decode(spark, sf_dir):
    model = tokenizer.byte_level()
    return _texts(spark, sf_dir).where("text is not null").select("doc_id", tokenizer.decode(model)(tokenizer.encode(model)("text")).alias("back"))


@query("tok_wordpiece", r"SELECT p_partkey, CAST(list_sum(list_transform(string_split(lower(p_type), ' '), lambda w: CASE WHEN length(w) = 0 THEN 0 WHEN regexp_matches(w, '^[a-z]+$') THEN length(w) ELSE 1 END)) AS BIGINT) AS n FROM part")
def _pieces(spark, sf_dir):
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = {c: i for i, c in enumerate(letters)} | {f"##{c}": 26 + i for i, c in enumerate(letters)} | {"[UNK]": 99}
    model = tokenizer.Tokenizer("wordpiece", vocab, normalizers=("lowercase",), pretokenizer="whitespace", unknown="[UNK]")
    return load(spark, sf_dir, "part").select("p_partkey", F.size(tokenizer.encode(model)("p_type")).cast("long").alias("n"))
