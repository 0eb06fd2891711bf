"""Object stores, repair, and checkpoints through the allow list."""

import collections
import hashlib
import io
import os
import pickle
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorloom.operators import objects as O
from tensorloom.sources import checkpoints, files, stores
from tensorloom.tensor import collect, literal


def _objects(spark):
    rows = spark.createDataFrame([(i, bytes([i]) * (i + 1)) for i in range(20)] * 2, "i long, payload binary")
    return rows.select(O.digest(F.col("payload")).alias("digest"), (F.col("i") % 3).cast("int").alias("otype"), F.octet_length("payload").cast("long").alias("logical_len"), "payload")


def test_packs(spark, tmp_path):
    stores.write_pack(_objects(spark), str(tmp_path / "pack"), partitions=3)
    pack = stores.open_pack(spark, str(tmp_path / "pack"))
    assert pack.count() == 20 and stores.index(pack).columns == ["digest", "otype", "logical_len"]
    assert "payload" not in stores.index(pack)._jdf.queryExecution().executedPlan().toString()
    one = hashlib.sha256(b"\x03" * 4).hexdigest()
    assert [bytes(r.payload) for r in stores.find(pack, [one]).collect()] == [b"\x03" * 4]
    assert {r.status for r in O.verify(pack).collect()} == {"valid"}
    broken = pack.withColumn("payload", F.when(F.col("digest") == one, b"x").otherwise(F.col("payload")))
    got = {r.status: r.n for r in stores.fsck(broken).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got == {"valid": 19, "renamed": 1}


def test_directory_and_recovery(spark, tmp_path):
    for body in (b"a", b"bb"):
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / hashlib.sha256(body).hexdigest()).write_bytes(body)
    assert {r.status for r in O.verify(stores.directory(spark, str(tmp_path / "d"))).collect()} == {"valid"}
    good = stores.record(b"one", 1) + b"junk OBJ1 junk" + stores.record(b"two", 2)
    bad = bytearray(stores.record(b"bad"))
    bad[-1] ^= 1
    (tmp_path / "raw").write_bytes(good + bytes(bad) + stores.record(b"three", 3)[:-1])
    got = {(bytes(r.payload), r.otype) for r in stores.recover(spark, str(tmp_path / "raw")).collect()}
    assert got == {(b"one", 1), (b"two", 2)}


def test_orders(spark):
    rows = [("l.10.w", 0, "f32", "d3"), ("l.2.w", 0, "f16", "d1"), ("head", 0, "f32", "d2"), ("l.2.w", 1, "f16", "d0")]
    df = spark.createDataFrame(rows, "name string, seq int, dtype string, digest string")
    names = lambda s, **k: [r.digest for r in stores.order(df, s, **k).collect()]
    assert names("linear") == ["d0", "d1", "d2", "d3"] and names("by-tensor") == ["d2", "d3", "d1", "d0"]
    assert names("by-layer") == ["d2", "d1", "d0", "d3"] and names("by-dtype") == ["d1", "d0", "d2", "d3"]
    base = spark.createDataFrame([("d0",), ("d3",)], "digest string")
    assert names("by-novelty", base=base) == ["d3", "d0", "d2", "d1"]


def test_read_cost(spark):
    deps = spark.createDataFrame([("s", 15, 25)], "source string, low long, high long")
    chunks = spark.createDataFrame([("s", k, 10 * k, 10 * k + 10, 100) for k in range(5)], "source string, seq int, low long, high long, bytes long")
    assert [tuple(r) for r in stores.read_cost(deps, chunks).collect()] == [("s", 2, 200, 0.4)]


class _Fake:
    """Pickles as a call of a named global."""

    def __init__(self, name, args, pid=None):
        self.name, self.args, self.pid = name, args, pid


def _checkpoint(tree) -> bytes:
    storages = {}

    class Name:
        def __init__(self, module, name):
            self.module, self.name = module, name

    class P(pickle._Pickler):
        def persistent_id(self, obj):
            return obj.pid if isinstance(obj, _Fake) and obj.pid else None

        def save(self, obj, save_persistent_id=True):
            if isinstance(obj, Name):
                self.write(pickle.GLOBAL + f"{obj.module}\n{obj.name}\n".encode())
                return
            if isinstance(obj, np.ndarray):
                key = str(len(storages))
                storages[key] = obj.astype("<f4").tobytes()
                stride = tuple(s // obj.itemsize for s in obj.strides)
                self.save(Name("torch._utils", "_rebuild_tensor_v2"))
                self.save((_Fake("s", (), ("storage", Name("torch", "FloatStorage"), key, "cpu", obj.size)), 0, obj.shape, stride, False, collections.OrderedDict()))
                self.write(pickle.REDUCE)
                return
            super().save(obj, save_persistent_id)

    body = io.BytesIO()
    P(body, protocol=2).dump(tree)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("m/data.pkl", body.getvalue())
        for k, raw in storages.items():
            z.writestr(f"m/data/{k}", raw)
    return out.getvalue()


def test_checkpoints(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    raw = _checkpoint({"x": {"w": a}, "b": a[0]})
    got = {n: v.reshape(s) for n, s, _, v in checkpoints.parse_pytorch(raw)}
    assert np.array_equal(got["x.w"], a) and np.array_equal(got["b"], a[0])
    (tmp_path / "m.pt").write_bytes(raw)
    assert np.array_equal(collect(files.cells(files.read(spark, str(tmp_path / "m.pt")), "x.w", (2, 3))), a)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("m/data.pkl", pickle.dumps({"x": os.system}))
    with pytest.raises(pickle.UnpicklingError):
        list(checkpoints.parse_pytorch(out.getvalue()))


def test_adapters(spark):
    rng = np.random.default_rng(0)
    w, a, b = rng.normal(size=(4, 3)), rng.normal(size=(2, 3)), rng.normal(size=(4, 2))
    base = {"q.weight": literal(spark, w)}
    adapter = {"base_model.model.q.lora_A.weight": literal(spark, a), "base_model.model.q.lora_B.weight": literal(spark, b)}
    got = checkpoints.apply_peft(base, adapter, {"peft_type": "LORA", "r": 2, "lora_alpha": 4})
    assert np.allclose(collect(got["q.weight"]), w + 2 * b @ a)
    for bad in ({"use_dora": True}, {"rank_pattern": {"q": 1}}):
        with pytest.raises(ValueError):
            checkpoints.apply_peft(base, adapter, {"peft_type": "LORA", "r": 2, **bad})


def test_other_adapters(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(4, 3))
    base = {"q.weight": literal(spark, w)}
    shapes = {"a1": (4, 2), "b1": (2, 3), "a2": (4, 2), "b2": (2, 3), "A": (5, 6), "B": (7, 5), "lb": (4,), "ld": (2,), "rows": (4, 1), "columns": (1, 3), "la": (2, 3), "lB": (4, 2), "e": (2, 1)}
    x = {k: rng.normal(size=n) for k, n in shapes.items()}

    def run(kind, parts, **config):
        given = {k: literal(spark, x[v]) for k, v in parts.items()}
        return collect(checkpoints.apply_peft(base, given, {"peft_type": kind, "r": 2, **config})["q.weight"])

    pre = "base_model.model.q."
    got = run("LOHA", {pre + "hada_w1_a": "a1", pre + "hada_w1_b": "b1", pre + "hada_w2_a": "a2", pre + "hada_w2_b": "b2"}, alpha=4)
    assert np.allclose(got, w + 2 * (x["a1"] @ x["b1"]) * (x["a2"] @ x["b2"]))
    got = run("VERA", {"base_model.vera_A": "A", "base_model.vera_B": "B", pre + "vera_lambda_b": "lb", pre + "vera_lambda_d": "ld"})
    assert np.allclose(got, w + x["lb"][:, None] * (x["B"][:4, :2] @ (x["ld"][:, None] * x["A"][:2, :3])))
    assert np.allclose(run("IA3", {pre + "ia3_l": "rows"}), w * x["rows"])
    assert np.allclose(run("IA3", {pre + "ia3_l": "columns"}, feedforward_modules=["q"]), w * x["columns"])
    got = run("ADALORA", {pre + "lora_A": "la", pre + "lora_B": "lB", pre + "lora_E": "e"}, lora_alpha=4)
    assert np.allclose(got, w + x["lB"] @ (x["la"] * x["e"]) * 4 / (2 + 1e-5))
    with pytest.raises(ValueError):
        run("VERA", {pre + "vera_lambda_b": "lb", pre + "vera_lambda_d": "ld"})
    with pytest.raises(ValueError):
        run("LOKR", {})
