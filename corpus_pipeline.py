"""A corpus pipeline of five stages, each a table of its own.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), with
docs the table that the stage before left, and returns what it keeps.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import decontaminate, exactdup, packing, quality, simhash
from tensorloom.llm.common import free_names, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is 0.5 or more.

    Null and empty texts score the intercept; repeated rows score alike, and a
    score of just 0.5 stays.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    (out,) = free_names(docs, "quality")
    return quality.score(docs, model, out=out).where(F.col(out) >= 0.5).drop(out)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest doc_id.

    Null and empty texts are equal; a null doc_id ranks below all others; of
    rows that repeat doc_id and text one stays.
    """
    return exactdup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, 0.8 of whose five-word shingles are shared, keep one document.

    That of the smallest doc_id stays, a null one ranking last; of one doc_id's
    texts that of the smallest hash; repeats of what stays stay.  All texts
    without a word are near copies.
    """
    return simhash.survivors(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of a benchmark item; one item is enough.

    Documents are told apart by doc_id and text, so repeated rows go or stay
    together; a document without a word stays.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left; one row per piece of a document.

    A document without text is its end id alone; repeated rows are packed each
    for itself; a text longer than a sequence is cut.  Other columns are left out.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier and the packer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
