"""The object graph: objects by digest, typed references, layers, integrity.

objects: digest, otype, logical_len, payload.  refs: src, dst, otype.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def digest(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def from_payloads(df: DataFrame, payload: str, otype: int = 0) -> DataFrame:
    """Objects of distinct payloads."""
    p = F.col(payload)
    rows = df.select(digest(p).alias("digest"), F.lit(otype).alias("otype"), F.octet_length(p).cast("long").alias("logical_len"), p.alias("payload"))
    return rows.groupBy("digest", "otype", "logical_len").agg(F.first("payload").alias("payload"))


def walk(refs: DataFrame, roots: DataFrame, *, wall: Sequence[int] = (), limit: int = 1000) -> DataFrame:
    """(digest, depth): everything reachable from the roots, at its least depth.

    Edges of the types in ``wall`` are not followed.  Each round joins the new
    frontier only, to edges that are written once; visited digests never come
    back, so cycles end.
    """
    edges = refs.where(~F.col("otype").isin(list(wall))) if wall else refs
    edges = written(edges.select(F.col("src").alias("digest"), "dst").distinct(), "edges")
    seen = front = written(roots.select("digest").distinct().withColumn("depth", F.lit(0)), "walk")
    for depth in range(1, limit + 1):
        new = front.join(edges, "digest").select(F.col("dst").alias("digest")).distinct().join(seen, "digest", "left_anti").withColumn("depth", F.lit(depth))
        new = written(new, "walk")
        if new.isEmpty():
            return seen
        seen, front = seen.unionByName(new), new
    raise ValueError(f"deeper than {limit}")


def dangling(refs: DataFrame, objects: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """References, of reached objects where given, whose target is absent."""
    own = refs if reached is None else refs.join(reached.select(F.col("digest").alias("src")), "src", "left_semi")
    return own.join(objects.select(F.col("digest").alias("dst")), "dst", "left_anti").select("src", "dst", "otype")


def copy_reachable(source: DataFrame, refs: DataFrame, target: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects that the target lacks of what is reachable, and (copied, present) counts."""
    reached = walk(refs, roots).select("digest")
    have = source.join(reached, "digest", "left_semi")
    copied = have.join(target.select("digest"), "digest", "left_anti")
    marks = have.join(target.select("digest", F.lit(1).alias("t")), "digest", "left")
    return copied, marks.agg(F.count_if(F.col("t").isNull()).alias("copied"), F.count_if(F.col("t").isNotNull()).alias("present"))


def layered(layers: Sequence[DataFrame]) -> DataFrame:
    """Objects of several stores; the first store that has a digest wins."""
    out = None
    for k, layer in enumerate(layers):
        part = layer.select("digest", "otype", "logical_len", "payload", F.lit(k).alias("layer"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("digest").agg(F.min_by(F.struct("otype", "logical_len", "payload", "layer"), "layer").alias("o"))
    return best.select("digest", "o.*")


def verify(objects: DataFrame, refs: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """Findings (level, digest, status, note), three-valued: lengths, digests, reference types, reachability."""
    payload = F.col("payload").cast("binary")
    length = F.when(F.col("payload").isNull(), "indeterminate").when(F.octet_length(payload) == F.col("logical_len"), "valid").otherwise("invalid")
    good = F.when(F.col("payload").isNull(), "indeterminate").when(F.sha2(payload, 256) == F.col("digest"), "valid").otherwise("invalid")
    out = objects.select("digest", F.explode(F.array(F.struct(F.lit("V1").alias("level"), length.alias("status"), F.lit("length").alias("note")), F.struct(F.lit("V3").alias("level"), good.alias("status"), F.lit("digest").alias("note")))).alias("f"))
    out = out.select("f.level", "digest", "f.status", "f.note")
    if refs is not None:
        types = refs.join(objects.select(F.col("digest").alias("dst"), F.col("otype").alias("is")), "dst", "left")
        status = F.when(F.col("is").isNull(), "indeterminate").when(F.col("is") == F.col("otype"), "valid").otherwise("invalid")
        out = out.unionByName(types.select(F.lit("V2").alias("level"), F.col("dst").alias("digest"), status.alias("status"), F.lit("reference type").alias("note")))
        if roots is not None:
            lost = dangling(refs, objects, walk(refs, roots))
            out = out.unionByName(lost.select(F.lit("V4").alias("level"), F.col("dst").alias("digest"), F.lit("invalid").alias("status"), F.lit("dangling").alias("note")))
    return out


def summary(findings: DataFrame) -> DataFrame:
    """Per level: invalid if anything is, else indeterminate if anything is, else valid."""
    bad, odd = F.count_if(F.col("status") == "invalid"), F.count_if(F.col("status") == "indeterminate")
    return findings.groupBy("level").agg(F.when(bad > 0, "invalid").when(odd > 0, "indeterminate").otherwise("valid").alias("status"), F.count("*").alias("findings"))


def strip(refs: DataFrame, roots: DataFrame, training: Sequence[int]) -> DataFrame:
    """(digest, part): inference is what roots reach without training edges; the rest is training."""
    inner = walk(refs, roots, wall=training).select("digest")
    whole = walk(refs, roots).select("digest")
    only = whole.join(inner, "digest", "left_anti").withColumn("part", F.lit("training"))
    return inner.withColumn("part", F.lit("inference")).unionByName(only)


def separation_violations(refs: DataFrame, parts: DataFrame, training: Sequence[int]) -> DataFrame:
    """Inference objects that refer to training ones by an edge that is no training edge."""
    a = parts.where("part = 'inference'").select(F.col("digest").alias("src"))
    b = parts.where("part = 'training'").select(F.col("digest").alias("dst"))
    return refs.where(~F.col("otype").isin(list(training))).join(a, "src", "left_semi").join(b, "dst", "left_semi")


def garbage(objects: DataFrame, refs: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects that no root reaches."""
    return objects.select("digest").join(walk(refs, roots).select("digest"), "digest", "left_anti")


def dedup(chunks: DataFrame) -> DataFrame:
    """One row: chunks and bytes as referred to, and as stored once."""
    once = chunks.groupBy("digest").agg(F.first("n").alias("n"), F.count("*").alias("uses"))
    got = once.agg(F.sum("uses").alias("referred"), F.count("*").alias("stored"), F.sum(F.col("n") * F.col("uses")).alias("referred_bytes"), F.sum("n").alias("stored_bytes"))
    return got.withColumn("ratio", F.col("stored_bytes") / F.col("referred_bytes"))


def completeness(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """One row: objects and bytes there, of those wanted (digest, logical_len)."""
    both = wanted.select("digest", "logical_len").join(present.select("digest", F.lit(1).alias("p")).distinct(), "digest", "left")
    here = F.col("p").isNotNull()
    return both.agg(F.count("*").alias("objects"), F.count_if(here).alias("objects_present"), F.sum("logical_len").alias("bytes"), F.coalesce(F.sum(F.when(here, F.col("logical_len"))), F.lit(0)).alias("bytes_present"))


def novel(objects: DataFrame, base: DataFrame) -> DataFrame:
    """Objects that the base does not have."""
    return objects.join(base.select("digest"), "digest", "left_anti")


def coalesce_ranges(ranges: DataFrame, *, gap: int, most: int, by: str = "source") -> DataFrame:
    """Merge byte ranges of a source, in order of offset and length.

    A range joins the one before it if it begins within ``gap`` of that one's end
    and the two together span ``most`` bytes at most; else it begins a new one.
    Empty ranges are left out.  Each source streams through one task, which
    holds the open range only.
    """

    def fold(batches):
        now = begin = end = parts = None
        for batch in batches:
            out = []
            for source, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if source == now and parts and offset <= end + gap and offset + length - begin <= most:
                    end, parts = max(end, offset + length), parts + 1
                    continue
                if parts:
                    out.append((now, begin, end - begin, parts))
                now, begin, end, parts = source, offset, offset + length, 1
            yield pack(out, batch.schema.field(0).type)
        if parts:
            yield pack([(now, begin, end - begin, parts)], kind)

    def pack(rows, of):
        nonlocal kind
        kind = of
        types = (of, pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [by, "offset", "length", "parts"])

    kind = None
    rows = ranges.where("length > 0").select(by, F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"))
    ordered = rows.repartition(by).sortWithinPartitions(by, "offset", "length")
    return ordered.mapInArrow(fold, f"`{by}` {rows.schema[by].dataType.simpleString()}, `offset` long, length long, parts long")


def inventory(tensors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tensors, elements and bytes per group of tensors."""
    return tensors.groupBy(*by).agg(F.count("*").alias("tensors"), F.sum("elements").alias("elements"), F.sum("bytes").alias("bytes"))


def load_order(tensors: DataFrame, hints: DataFrame) -> DataFrame:
    """Names in declared order first, then the rest by name."""
    both = tensors.select("name").join(hints.select("name", "pos"), "name", "left")
    return both.select("name", F.row_number().over(Window.orderBy(F.col("pos").asc_nulls_last(), "name")).alias("rank"))


def history(steps: DataFrame) -> DataFrame:
    """Training steps with the change of step and loss against the parent."""
    parent = steps.select(F.col("digest").alias("parent"), F.col("step").alias("parent_step"), F.col("loss").alias("parent_loss"))
    both = steps.join(parent, "parent", "left")
    return both.select("digest", "step", "loss", (F.col("step") - F.col("parent_step")).alias("steps"), (F.col("loss") - F.col("parent_loss")).alias("loss_change"))


def signature_policy(verdicts: DataFrame, *, rule: str, k: int = 1, purposes: Sequence[str] = (), at: int | None = None) -> DataFrame:
    """(digest, status, accepted): any, all or k-of-n over verdict rows.

    verdicts: digest, key, ok, purpose, not_before, not_after, revoked.  The
    validity window is left out where no time is given.
    """
    ok = F.col("ok") & ~F.coalesce("revoked", F.lit(False))
    if purposes:
        ok = ok & F.col("purpose").isin(list(purposes))
    if at is not None:
        ok = ok & (F.coalesce("not_before", F.lit(at)) <= at) & (F.coalesce("not_after", F.lit(at)) >= at)
    need = {"any": F.lit(1), "all": F.col("n"), "k-of-n": F.lit(k)}.get(rule)
    if need is None:
        raise ValueError(f"no rule {rule!r}")
    got = verdicts.groupBy("digest").agg(F.count_distinct(F.when(ok, F.col("key"))).alias("accepted"), F.count_distinct("key").alias("n"))
    return got.select("digest", F.when(F.col("accepted") >= need, "valid").otherwise("invalid").alias("status"), "accepted")


def params_total(tensors: DataFrame, machinery: DataFrame) -> DataFrame:
    """One row: elements of weights, without the tensors that only serve a scheme (R-M01)."""
    own = tensors.where("semantic = 'weight'").join(machinery.select("name"), "name", "left_anti")
    return own.agg(F.coalesce(F.sum("elements"), F.lit(0)).alias("params"), F.count("*").alias("tensors"))


def lineage(parents: DataFrame, start: str, limit: int = 32) -> DataFrame:
    """(digest, depth) of an object and everything that it descends from."""
    edges = parents.where("parent is not null").select(F.col("digest").alias("src"), F.col("parent").alias("dst"), F.lit(0).alias("otype"))
    return walk(edges, parents.sparkSession.createDataFrame([(start,)], "digest string"), limit=limit)


def stat(objects: DataFrame, names: DataFrame, on: Sequence[str] = ("digest",)) -> DataFrame:
    """Objects, bytes and names per type; objects without a name count as internal.

    A name belongs to the objects that are the same in ``on``, missing values included.
    """
    named = names.select(*(F.col(c).alias(f"_{c}") for c in on), "name")
    both = objects.join(named, functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on)), "left")
    return both.groupBy("otype").agg(F.count_distinct("digest").alias("objects"), F.sum("logical_len").alias("bytes"), F.count("name").alias("named"))
