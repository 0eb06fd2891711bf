import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tensorloom.llm import exactdup

from .edge import SF, TEXTS, clashing, documents
from .test_dedup import _brute_near

_WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _words(text):
    return _WORDS.findall((text or "").translate(_LOWER))


def _windows(items, n=8):
    """All windows of the items' words."""
    out = set()
    for text in items:
        w = _words(text)
        out |= {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def _holds(text, windows):
    w = _words(text)
    return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "packing"]
    kept = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).persist()
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.join(before, columns, "left_anti").isEmpty()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = kept["start"].join(labels.where("quality = 1"), "doc_id", "left_semi").count()
    assert kept["quality"].join(labels.where("quality = 1"), "doc_id", "left_semi").count() >= 0.98 * good
    assert kept["quality"].join(labels.where("quality = 0"), "doc_id", "left_semi").count() == 0
    best = kept["quality"].groupBy("text").agg(F.max("doc_id").alias("doc_id"))
    assert kept["exact"].count() == best.count() and kept["exact"].join(best, ["doc_id", "text"], "left_anti").isEmpty()
    rows = {n: {r.doc_id: r.text for r in kept[n].collect()} for n in ("exact", "near", "benchmark")}
    least, _ = _brute_near(list(rows["exact"].items()))
    assert set(rows["near"]) == set(least.values())
    windows = _windows(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id is not null").collect())
    assert set(rows["benchmark"]) == {d for d, t in rows["near"].items() if not _holds(t, windows)} < set(rows["near"])
    assert kept["packing"].select("doc_id").distinct().count() == kept["benchmark"].count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, name, stage):
    """Nulls, empty and long texts, repeated rows, columns of any name, and an empty table."""
    docs = clashing(documents(spark, [r for r in TEXTS if "\0" not in (r[1] or "")])).withColumn("score", F.lit("mine"))
    got = stage(spark, docs, SF)
    rows = got.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert sum(r.length for r in rows) > 0 and sum(r.start == 0 for r in rows) == docs.count()
        return
    assert got.columns == docs.columns and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    texts = [t or "" for _, t in TEXTS if "\0" not in (t or "")]
    if name == "exact":
        assert sorted(r.text or "" for r in rows) == sorted(set(texts))
    if name == "benchmark":
        assert len(rows) == len(texts)
    if name == "near":
        assert len(exactdup.groups(got.select("doc_id", "text")).where("kept").collect()) == len({r.text for r in rows if r.text}) + any(not r.text for r in rows)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_benchmark_stage_drops_one_item(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, f"before it {item} and after it"), (2, item), (3, "clean words that no item holds"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, SF).collect()) == [3, 4]
    two = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(2).collect()
    mixed = [(5, " and ".join(r.text for r in two)), (6, " ".join(item.split()[:5])), (7, f"{' '.join(item.split()[-8:])}")]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, SF).collect()) == [3, 4, 6]
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    windows = _windows(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    kept = {r.doc_id for r in corpus_pipeline.benchmark_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert kept == {d for d, t in given.items() if not _holds(t, windows)} < set(given)
