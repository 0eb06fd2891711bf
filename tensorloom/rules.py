"""Checks of tensors, metadata, tokenizers and templates, as rows (rule, name, status, note)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import template, tokenizer
from .operators.quant import Scheme, block_grid
from .plans import expr as E
from .scratch import written

MOST_DEPTH = 256
FINDING = "rule string, name string, status string, note string"


def _three(ok: Column) -> Column:
    """valid, invalid, or indeterminate where nothing is known."""
    return F.when(ok.isNull(), "indeterminate").when(ok, "valid").otherwise("invalid")


def _finding(rule: str, name: Column, ok: Column, note: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), name.cast("string").alias("name"), _three(ok).alias("status"), note.alias("note")]


def chunk_totals(tensors: DataFrame, chunks: DataFrame) -> DataFrame:
    """R-T02: a tensor's declared total is the sum of its chunks, and the bytes that its elements take.

    ``tensors`` has name, total, elements and bits; ``chunks`` has name and length.
    """
    sums = chunks.groupBy("name").agg(F.sum("length").alias("held"))
    need = F.ceil(F.col("elements") * F.col("bits") / 8)
    ok = (F.col("total") == F.col("held")) & (F.col("total") == need)
    note = F.concat_ws(" ", F.lit("total"), "total", F.lit("chunks"), "held", F.lit("needed"), need)
    return tensors.join(sums, "name", "left").select(*_finding("R-T02", F.col("name"), ok, note))


def scheme_shapes(spark: SparkSession, tensors: dict[str, tuple[Scheme, Sequence[int], dict[str, Sequence[int]]]]) -> DataFrame:
    """R-T04: scales and zero points have the shape of the block grid, books one axis, an order the first extent."""
    rows = []
    for name, (scheme, shape, given) in sorted(tensors.items()):
        bad = []
        try:
            want = block_grid(shape, scheme.block)
        except ValueError as e:
            want, bad = None, [str(e)]
        for part, own in sorted(given.items()):
            if part in ("scale", "zero") and want is not None and tuple(own) != want and set(own) != {1}:
                bad.append(f"{part} {tuple(own)} where the grid is {want}")
            if part == "book" and len(own) != 1:
                bad.append(f"book {tuple(own)}")
            if part == "order" and tuple(own) != tuple(shape[:1]):
                bad.append(f"order {tuple(own)} of {tuple(shape)}")
        rows.append(("R-T04", name, "invalid" if bad else "valid", "; ".join(bad)))
    return spark.createDataFrame(rows, FINDING)


def _depth(e: E.Expr) -> int:
    deepest, stack = 0, [(e, 1)]
    while stack:
        x, n = stack.pop()
        deepest = max(deepest, n)
        stack += [(y, n + 1) for y in x.args]
    return deepest


def _bare_loss(e: E.Expr) -> str:
    """The first lossy node that no ``approx`` stands above."""
    stack = [e]
    while stack:
        x = stack.pop()
        if x.op == "approx":
            continue
        if E.is_lossy(x) and not any(E.is_lossy(y) for y in x.args):
            return x.op
        stack += list(x.args)
    return ""


def expressions(spark: SparkSession, tensors: dict[str, E.Expr]) -> DataFrame:
    """R-T05: expressions are no deeper than ``MOST_DEPTH``; R-T06: what loses is marked as approximate."""
    rows = []
    for name, e in sorted(tensors.items()):
        depth = _depth(e)
        rows.append(("R-T05", name, "valid" if depth <= MOST_DEPTH else "invalid", f"depth {depth}"))
        bare = _bare_loss(e) if depth <= MOST_DEPTH else ""
        rows.append(("R-T06", name, "indeterminate" if depth > MOST_DEPTH else "invalid" if bare else "valid", bare))
    return spark.createDataFrame(rows, FINDING)


def metadata(configs: DataFrame) -> DataFrame:
    """R-M02: a rope says whether it is interleaved.  ``configs`` has name, rope_kind and interleaved (a boolean)."""
    ok = F.when(F.col("rope_kind") == "rope", F.col("interleaved").isNotNull()).otherwise(True)
    return configs.select(*_finding("R-M02", F.col("name"), ok, F.lit("rope.interleaved")))


def vocabulary(sizes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """R-M05: a tokenizer's vocabulary (name, vocab) against the embedding's axis (name, rows); absent where either is not there."""
    both = sizes.join(embeddings, "name", "left")
    return both.select(*_finding("R-M05", F.col("name"), F.col("vocab") == F.col("rows"), F.concat_ws(" ", "vocab", F.lit("of"), "rows")))


def token_vectors(model: tokenizer.Tokenizer, vectors: DataFrame) -> DataFrame:
    """R-M03: a tokenizer gives the recorded ids.  ``vectors`` has name, text and ids."""
    got = vectors.withColumn("got", tokenizer.encode(model)("text"))
    return got.select(*_finding("R-M03", F.col("name"), F.col("got") == F.col("ids").cast("array<int>"), F.col("text")))


def template_vectors(source: str, vectors: DataFrame) -> DataFrame:
    """R-M04: a template gives the recorded text.  ``vectors`` has name, input (JSON) and rendered."""
    got = vectors.withColumn("got", template.render(source)("input"))
    return got.select(*_finding("R-M04", F.col("name"), F.col("got") == F.col("rendered"), F.col("rendered")))


def dataloader(events: DataFrame, *, by: str = "worker", at: str = "position", batch: int = 1) -> DataFrame:
    """Where a data loader stands: per worker the samples it has given, its position, whole batches and the rest.

    A position that repeats counts once, so a resumed worker is not counted twice.
    """
    once = events.select(by, at).distinct()
    got = once.groupBy(by).agg(F.count("*").alias("samples"), F.max(at).alias("position"))
    return got.select(by, "samples", "position", F.expr(f"samples div {batch}L").alias("batches"), (F.col("samples") % batch).alias("rest"))


def random_states(states: DataFrame) -> DataFrame:
    """The last random state of each (scope, worker), by step; a scope without a worker is worker -1."""
    best = states.withColumn("worker", F.coalesce("worker", F.lit(-1))).groupBy("scope", "worker")
    return best.agg(F.max("step").alias("step"), F.max_by("state", "step").alias("state"))


def optimizer_rows(moments: DataFrame, parameters: DataFrame) -> DataFrame:
    """Per parameter whether every moment that its optimizer keeps has its shape: name, moments, status.

    ``moments`` has name, moment and elements; ``parameters`` has name and elements.
    """
    held = moments.groupBy("name").agg(F.count("*").alias("moments"), F.min("elements").alias("low"), F.max("elements").alias("high"))
    both = parameters.join(held, "name", "left")
    ok = (F.col("low") == F.col("elements")) & (F.col("high") == F.col("elements"))
    return both.select("name", F.coalesce("moments", F.lit(0)).alias("moments"), _three(ok).alias("status"))


def provides(manifests: DataFrame, needed: DataFrame) -> DataFrame:
    """What plugins provide against what expressions need: (ns, name, version, status).

    ``manifests`` has plugin, ns, name and version; a plugin serves its own
    version and older ones of the name.
    """
    have = written(manifests.groupBy("ns", "name").agg(F.max("version").alias("newest")), "provides")
    both = needed.select("ns", "name", "version").distinct().join(have, ["ns", "name"], "left")
    status = F.when(F.col("newest").isNull(), "absent").when(F.col("newest") >= F.col("version"), "served").otherwise("too old")
    return both.select("ns", "name", "version", status.alias("status"))
