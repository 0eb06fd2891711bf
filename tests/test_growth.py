"""What must not grow with the input in one place: the driver, one task, or one worker."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tensorloom import registry
from tensorloom.functions import tokenizer
from tensorloom.operators import contract, delta, nn, quant
from tensorloom.sources import files, gguf
from tensorloom.tensor import collect, from_cells, literal

RNG = np.random.default_rng(5)
SF = "/root/testdata/sf0.001"


def plan(t) -> str:
    return t.df._jdf.queryExecution().executedPlan().toString()


def test_products_broadcast_no_tiles(spark):
    a, b = RNG.normal(size=(300, 64)), RNG.normal(size=(64, 270))
    got = contract.matmul(literal(spark, a), literal(spark, b))
    assert "Broadcast" not in plan(got) and "SortMergeJoin" not in plan(got)  # tiles meet without a join, whose one side may be broadcast through the driver
    assert np.allclose(collect(got), a @ b)


@pytest.mark.parametrize("causal", [False, True])
def test_attention_sends_no_partial_results(spark, causal, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(nn, "BLOCK_KEYS", 4)
    q = RNG.normal(size=(1, 1, 100, 2))
    t = literal(spark, q)
    got = nn.attention(t, t, t, causal=causal)
    assert "Broadcast" not in plan(got) and "SortMergeJoin" not in plan(got)
    s = q[0, 0] @ q[0, 0].T / np.sqrt(2)
    p = np.exp(np.where(np.tri(100) > 0, s, -np.inf) if causal else s)
    assert np.allclose(collect(got)[0, 0], p / p.sum(axis=1, keepdims=True) @ q[0, 0])


def test_quantized_product_broadcasts_no_tiles(spark):
    q, b = RNG.integers(-9, 9, size=(300, 64)).astype(float), RNG.normal(size=(64, 270))
    got = quant.qmatmul(literal(spark, q, to="i8"), literal(spark, b), quant.Scheme("sym", "i8"), scale=literal(spark, [[0.1]]))
    assert "SortMergeJoin" not in plan(got) and "CartesianProduct" not in plan(got) and plan(got).count("BroadcastExchange") <= 1  # the scale
    assert np.allclose(collect(got), 0.1 * q @ b)


def test_one_parameter_is_no_product_of_partitions(spark):
    x = literal(spark, RNG.integers(-9, 9, size=(20, 8)))
    one = {k: literal(spark, [[v]]) for k, v in (("scale", 0.5), ("zero", 1.0), ("scale_scale", 2.0), ("scale_zero", 0.25))}
    got = quant.dequantize(x, quant.Scheme("nested"), **one)
    assert "CartesianProduct" not in plan(got) and "SortMergeJoin" not in plan(got)
    assert np.allclose(collect(got), (collect(x) - 1) * 0.5)


def test_search_broadcasts_no_rows_and_equal_rows_tie(spark):
    rows = RNG.normal(size=(700, 8))
    rows[650] = rows[3]  # in another block, of another size
    e = literal(spark, rows)
    scores, index = nn.cosine_topk(e, literal(spark, rows[:4]), 3)
    assert "Broadcast" not in plan(scores) and "SortMergeJoin" not in plan(scores)
    assert collect(index)[3, :2].tolist() == [3, 650]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    assert np.allclose(collect(scores), -np.sort(-(unit[:4] @ unit.T), axis=1)[:, :3])


def test_object_stat_counts_a_text_in_each_of_its_languages(spark, tmp_path):
    import duckdb

    rows = [(1, "aa", "en"), (2, "aa", "fr"), (4, "aa", "deu"), (5, "bé", None), (6, "bé", "en"), (8, None, "en"), (9, None, None), (10, "cc", "en"), (11, "cc", "en")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["object_stat"](spark, str(tmp_path)).select("otype", "objects", "bytes", "named").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT otype, objects, bytes, named FROM ({registry.oracle_sql()['object_stat']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_whole_texts_are_not_kept_as_words(spark):
    model = tokenizer.Tokenizer("char", {c: i for i, c in enumerate("abc")})
    texts = ["abc" * 50, "ab"]
    assert [model.encode(t) for t in texts] == [[0, 1, 2] * 50, [0, 1]]
    assert set(model._cache) == {"ab"}
    raw = pa.array(["x", "aé", None, "", "xyz"]).slice(1)
    assert tokenizer._bytes_of(raw).to_pylist() == [[97, 195, 169], None, [], [120, 121, 122]]
    df = spark.createDataFrame([(1, "aé"), (2, None), (3, ""), (4, "xyz" * 9)], "i int, t string")
    ids = tokenizer.encode(tokenizer.byte_level())("t")
    assert [r.b for r in df.select("i", tokenizer.decode(tokenizer.byte_level())(ids).alias("b")).orderBy("i").collect()] == ["aé", None, "", "xyz" * 9]


def test_texts_come_in_small_batches(spark):
    from tensorloom.functions import codecs, rows

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        assert rows.small_batches(spark).conf.get(key) == rows.TEXT_ROWS
        spark.conf.set(key, "77")
        assert rows.small_batches(spark).conf.get(key) == "77"
        spark.conf.set(key, "10000")
        registry.queries()["codec_zlib"](spark, SF)
        assert spark.conf.get(key) == rows.TEXT_ROWS
    finally:
        spark.conf.set(key, was)
    df = spark.createDataFrame([(i, "ab" * i if i % 7 else None) for i in range(1000)], "i int, t string")
    back = codecs.decode(codecs.encode(df.t, "zlib"), "zlib").cast("string")
    assert df.where(~back.eqNullSafe(df.t)).count() == 0


@pytest.mark.parametrize("kind", ["safetensors", "npy", "npz", "gguf"])
def test_files_of_more_than_the_driver_collects(spark, tmp_path, kind):
    n = (1 << 20) + 300
    t = from_cells(spark.range(n).where("id % 1000 <> 7").selectExpr("id AS pos", "CAST(id % 4096 AS DOUBLE) AS v"), (n // 4, 4))
    path = str(tmp_path / f"e.{kind}")
    files.write_file(spark, {"e": t}, path)
    back = files.cells(files.read(spark, path), "e", t.shape).cells()
    wrong = back.where("NOT (v <=> IF(pos % 1000 = 7, double('NaN'), CAST(pos % 4096 AS DOUBLE)))").count()
    assert back.count() == n and wrong == 0
    small = from_cells(t.cells().where("pos < 12"), (3, 4))
    files.write_file(spark, {"e": small}, str(tmp_path / f"s.{kind}"))
    raw = (tmp_path / f"s.{kind}").read_bytes()
    if kind == "npz":
        assert np.array_equal(np.load(tmp_path / "s.npz")["e"], collect(small), equal_nan=True)
    else:
        made = {"safetensors": lambda: files.to_safetensors({"e": small}), "npy": lambda: files.to_npy(small), "gguf": lambda: gguf.write({"e": collect(small)})}
        assert raw == made[kind]()


@pytest.mark.parametrize("shape", [(50, 7), (7, 50), (12, 12)])
def test_low_rank_by_blocks(spark, monkeypatch, shape):
    monkeypatch.setattr(delta, "FACTORED_ROWS", 8)
    a, zero = RNG.normal(size=shape), np.zeros(shape)
    zero[0, 0] = 2.0
    rows = [(t, p, float(v)) for t, m in (("a", a), ("z", zero)) for p, v in enumerate(m.ravel()) if v]
    got = delta.low_rank(spark.createDataFrame(rows, "tensor string, pos long, v double"), *shape, 3)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()  # a tensor whole in one task
    got = got.collect()
    for name, m in (("a", a), ("z", zero)):
        own = [r for r in got if r.tensor == name]
        u, v = np.zeros((shape[0], 3)), np.zeros((shape[1], 3))
        for r in own:
            (u if r.side == "u" else v)[r.i, r.k] = r.x
        sigma = [next(r.sigma for r in own if r.k == k) for k in range(3)]
        left, want, right = np.linalg.svd(m, full_matrices=False)
        assert len(own) == 3 * sum(shape) and np.allclose(sigma, want[:3])
        assert np.allclose(u * sigma @ v.T, left[:, :3] * want[:3] @ right[:3])


def test_digest_of_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(delta, "PIECE", 64)
    a = {t: RNG.normal(size=1000) for t in "xy"}
    cells = spark.createDataFrame([(t, p, float(v)) for t, m in a.items() for p, v in enumerate(m)], "tensor string, pos long, v double").repartition(5)
    whole = delta.chunk_digests(cells, chunk=1 << 62)
    assert whole._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # cells are packed before one task has a tensor
    assert {r.tensor: r.digest for r in whole.collect()} == {t: hashlib.sha256(m.tobytes()).hexdigest() for t, m in a.items()}
    parts = {(r.tensor, r.seq): r.digest for r in delta.chunk_digests(cells, chunk=100).collect()}
    assert parts == {(t, k): hashlib.sha256(m[100 * k : 100 * k + 100].tobytes()).hexdigest() for t, m in a.items() for k in range(10)}


def test_interpolation_is_dealt_by_its_size(spark, monkeypatch):
    monkeypatch.setattr(nn, "MET_ROWS", 16)
    x = RNG.normal(size=(1, 1, 5, 8))
    got = nn.interpolate(literal(spark, x), [2, 1], "linear")
    assert "src#" in plan(got) and ", 10), REPARTITION_BY_NUM" in plan(got)  # 80 cells of two corners each
    at = np.clip((np.arange(10) + 0.5) / 2 - 0.5, 0, None)
    low = np.minimum(at.astype(int), 4)
    want = x[0, 0][low] * (1 - (at - low))[:, None] + x[0, 0][np.minimum(low + 1, 4)] * (at - low)[:, None]
    assert np.allclose(collect(got)[0, 0], want)
