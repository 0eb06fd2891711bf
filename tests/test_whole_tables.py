"""Queries without SQL on embeddings, over the whole table, against NumPy."""

import numpy as np
import pytest

from tensorloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], dtype=float)


def test_lowrank_delta(spark, embeddings):
    got = registry.queries()["lowrank_delta"](spark, SF).orderBy("k").collect()
    want = np.linalg.svd(embeddings, compute_uv=False)[:3]
    assert [r.k for r in got] == [0, 1, 2] and np.allclose([r.sigma for r in got], want, atol=1e-4)


def test_dare_merge(spark, embeddings):
    got = registry.queries()["dare_merge"](spark, SF).orderBy("pos").collect()
    a, b = (2 * embeddings[:, h].ravel() for h in (slice(0, 32), slice(32, 64)))
    v = np.array([r.v for r in got])
    assert [r.pos for r in got] == list(range(len(a)))
    ways = np.abs(np.stack([0 * a, a, b, a + b]) - v)
    assert ways.min(axis=0).max() < 1e-5
    assert all(abs(n / len(v) - 0.25) < 0.03 for n in np.bincount(ways.argmin(axis=0), minlength=4))
