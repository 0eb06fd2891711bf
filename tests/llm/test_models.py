import zlib

import numpy as np
import pyarrow as pa
import pytest

from tensorloom.llm import bytewords, langid, quality, queries_models

from .edge import TEXTS, clashing, documents

SF = "/root/testdata/sf0.01"


def test_hashes_follow_words():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab é\n"), int(rng.integers(0, 40)))) for _ in range(300)] + ["", "x" * (3 << 20)]
    data, offsets = bytewords.raw_bytes(pa.array([*texts, None]))
    starts, ends, first = bytewords.spans(data, offsets, bytewords.NOT_SPACE)
    hashes = bytewords.hashes(data, starts, ends)
    want = [w for t in texts for w in t.encode().split()]
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == want
    assert first.tolist() == np.concatenate([[0], np.cumsum([len(t.encode().split()) for t in texts] + [0])]).tolist()
    seen = {}
    for w, h in zip(want, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_segment_sums():
    v = np.arange(10.0)
    first = np.array([0, 0, 3, 3, 10])
    assert bytewords.segment_sums(v, first).tolist() == [0, 3, 0, 42]
    table = np.stack([v, -v], axis=1)
    codes = np.arange(10)
    for block in (1, 3, 100):
        assert bytewords.gathered_sums(table, codes, first, block).tolist() == [[0, 0], [3, -3], [0, 0], [42, -42]]


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries_models.op10_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_language_held_out(spark):
    rows = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries_models.op6_language(spark, SF).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == rows[r.doc_id] for r in held]) > 0.97


def test_model_edges(spark):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(documents(spark), labels)
    got = quality.score(clashing(documents(spark)), model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    empty = quality.fit(documents(spark, []), labels)
    assert all(r.score == 0.5 for r in quality.score(documents(spark), empty).collect())
    langs = documents(spark).selectExpr("doc_id", "text", "case when doc_id < 9 then 'en' else 'xx' end as lang")
    found = langid.identify(clashing(langs), langid.fit(langs)).collect()
    assert len(found) == len(TEXTS)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in found)
    none = langid.identify(langs, langid.fit(langs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_rows_score_alike_alone_and_together(spark):
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ["", None, "a", "a a a a a"]
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    whole = model.predict(pa.array(rows))
    assert np.allclose(whole, [model.predict(pa.array([t], pa.string()))[0] for t in rows])
    lang = langid.Model(("a", "b"), rng.normal(size=(1 << langid.BITS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.5)
    whole = lang.predict(pa.array(rows))[1]
    assert np.allclose(whole, [lang.predict(pa.array([t], pa.string()))[1][0] for t in rows])


def test_folded_table_equals_embeddings():
    rows = langid._rows(pa.array(["the cat sat", "le chat noir", "the dog", "un chien"] * 5))
    model = langid.train(rows, ["en", "fr", "en", "fr"] * 5)
    names, score, _ = model.predict(pa.array(["the cat", "le chien"]))
    assert names == ["en", "fr"] and (score > 0.5).all()


def _slow_ftrl(rows, labels, order_seed, alpha=0.3, beta=1.0, l1=0.002, epochs=2):
    """Coordinate by coordinate, in plain numbers."""
    positive = sum(labels) / len(labels)
    weight = [(0.5 / (1 - positive)) ** 0.5, (0.5 / positive) ** 0.5]
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def w(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha)

    order = np.random.default_rng(order_seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            idx, x = rows[k]
            bias = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-(sum(w(i) * v for i, v in zip(idx, x, strict=True)) + bias)))
            g = (p - labels[k]) * weight[labels[k]]
            for i, v in zip(idx, x, strict=True):
                own, old = w(i), n.get(i, 0.0)
                n[i] = old + (g * v) ** 2
                z[i] = z.get(i, 0.0) + g * v - (n[i] ** 0.5 - old**0.5) / alpha * own
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    return {i: w(i) for i in z}, -zb / ((beta + nb**0.5) / alpha)


def test_ftrl_against_a_slow_form():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "Dd", "7", "e-e", "ff", "g"], int(rng.integers(1, 20)))) for _ in range(40)]
    labels = rng.integers(0, 2, 40)
    rows = quality._rows(pa.array(texts))
    model = quality.train(rows, labels, epochs=2, seed=3)
    slow, bias = _slow_ftrl(rows, labels.tolist(), 3)
    assert abs(model.bias - bias) < 1e-9 and all(abs(model.weights[i] - v) < 1e-6 for i, v in slow.items())
    assert np.count_nonzero(model.weights) == sum(v != 0 for v in slow.values())
    scores = model.predict(pa.array(texts))
    want = [1 / (1 + np.exp(-(sum(model.weights[i] * v for i, v in zip(idx, x, strict=True)) + model.bias))) for idx, x in rows]
    assert np.allclose(scores, want, atol=1e-6)


def test_sgd_against_a_slow_form():
    """The folded table gives what embeddings, their mean and the softmax layer give."""
    texts = ["the cat sat", "le chat noir", "the dog", "un chien", "der hund"] * 4
    names = ["en", "fr", "en", "fr", "de"] * 4
    rows = langid._rows(pa.array(texts))
    model = langid.train(rows, names, epochs=2, seed=5)
    rng = np.random.default_rng(5)
    embed = rng.normal(0, 0.1, (1 << langid.BITS, langid.DIM))
    layer, bias = rng.normal(0, 0.1, (langid.DIM, 3)), np.zeros(3)
    step, steps = 0, 2 * len(rows)
    for _ in range(2):
        for i in rng.permutation(np.arange(len(rows))):
            idx, x = rows[i]
            lr = 4.0 * (1 - step / steps)
            step += 1
            mean = sum(v * embed[j] for j, v in zip(idx, x, strict=True))
            e = np.exp(mean @ layer + bias - (mean @ layer + bias).max())
            g = e / e.sum()
            g[["de", "en", "fr"].index(names[i])] -= 1
            back, norm = layer @ g, min(50.0, 1 / float(sum(v * v for v in x)) ** 0.5)
            for a in range(langid.DIM):
                layer[a] -= 0.1 * lr * mean[a] * g
            bias -= 0.01 * lr * g
            for j, v in zip(idx, x, strict=True):
                embed[j] -= lr * v * back * norm
    assert np.allclose(model.table, embed @ layer, atol=1e-5) and np.allclose(model.bias, bias)
    idx, x = langid._rows(pa.array(["the chat hund"]))[0]
    logits = (x @ (embed @ layer)[idx] + bias) / model.temperature
    p = np.exp(logits - logits.max())
    assert np.allclose(model.predict(pa.array(["the chat hund"]))[1], p.max() / p.sum(), atol=1e-4)


def test_every_language_is_learned(spark):
    """More languages than a small bound shares out, and two rare ones."""
    rows = [(k, f"word{k % 30} tok{k % 30}", f"l{k % 30:02}") for k in range(900)] + [(1000, "rare one", "r1"), (1001, "rare two", "r2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(df, per_language=20, most=60).languages) == 32


@pytest.mark.parametrize("words", [200_000])
def test_very_long_texts(spark, words):
    long = "alpha beta gamma delta " * (words // 4)
    df = documents(spark, [(1, long), (2, "alpha beta"), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.score(df, quality.fit(df, labels)).count() == 3
    langs = df.selectExpr("doc_id", "text", "'en' as lang")
    assert {r.doc_id: r.lang_pred for r in langid.identify(langs, langid.fit(langs)).collect()} == {1: "en", 2: "en", 3: "und"}
