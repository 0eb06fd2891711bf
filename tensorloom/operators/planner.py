"""Choosing a representation for each tensor, and moving shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBJECTIVES = ("min-memory", "max-quality", "min-load-time", "min-latency", "balanced")


def _order(objective: str) -> list[Column]:
    """What comes first under an objective; ties by the encoded representation."""
    cost = {
        "min-memory": [F.col("bytes"), -F.col("quality")],
        "max-quality": [-F.col("quality"), F.col("bytes")],
        "min-load-time": [F.col("load"), F.col("bytes")],
        "min-latency": [F.col("latency"), F.col("bytes")],
        "balanced": [F.col("bytes") / (1 << 20) - 100 * F.col("quality")],
    }.get(objective)
    if cost is None:
        raise ValueError(f"no objective {objective!r}")
    return [*cost, F.col("repr")]


def feasible(candidates: DataFrame, capabilities: DataFrame, *, optimistic: bool = False, lossy: bool = True) -> DataFrame:
    """Candidates with status yes, refused or unknown, from all features that they need.

    candidates: tensor, repr, bytes, quality, load, latency, lossy, features.
    capabilities: feature, support.  Unknown counts as yes where optimistic.
    """
    flat = candidates.select("tensor", "repr", F.explode_outer("features").alias("feature")).join(capabilities, "feature", "left")
    support = F.when(F.col("feature").isNull(), "yes").otherwise(F.coalesce("support", F.lit("unknown")))
    worst = flat.withColumn("support", support).groupBy("tensor", "repr").agg(F.count_if(F.col("support") == "refused").alias("no"), F.count_if(F.col("support") == "unknown").alias("odd"))
    status = F.when(F.col("no") > 0, "refused").when((F.col("odd") > 0) & F.lit(not optimistic), "unknown").otherwise("yes")
    out = candidates.join(worst, ["tensor", "repr"]).withColumn("status", status).drop("no", "odd")
    return out if lossy else out.withColumn("status", F.when(F.col("lossy"), "refused").otherwise(F.col("status")))


def pick(checked: DataFrame, objective: str) -> DataFrame:
    """The best feasible candidate of each tensor."""
    order = Window.partitionBy("tensor").orderBy(*_order(objective))
    return checked.where("status = 'yes'").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "status")


def resolve(candidates: DataFrame, capabilities: DataFrame, objective: str = "balanced", *, budget: int | None = None, optimistic: bool = False, lossy: bool = True) -> tuple[DataFrame, DataFrame]:
    """The plan, and reasons (tensor, reason) for what could not be met.

    A plan over the budget is tried once more for least memory.
    """
    checked = feasible(candidates, capabilities, optimistic=optimistic, lossy=lossy)
    plan = pick(checked, objective)
    unmet = checked.groupBy("tensor").agg(F.count_if(F.col("status") == "yes").alias("ok"), F.count_if(F.col("status") == "unknown").alias("odd")).where("ok = 0")
    reasons = unmet.select("tensor", F.when(F.col("odd") > 0, "no candidate is known to be supported").otherwise("every candidate is refused").alias("reason"))
    if budget is not None:
        total = plan.agg(F.sum("bytes")).first()[0] or 0
        if total > budget:
            plan = pick(checked, "min-memory")
            total = plan.agg(F.sum("bytes")).first()[0] or 0
            if total > budget:
                over = candidates.sparkSession.createDataFrame([("*", f"{total} bytes are over the budget of {budget}")], "tensor string, reason string")
                reasons = reasons.unionByName(over)
    return plan, reasons


# -- shards ---------------------------------------------------------------------------


def _cells(lo: str = "lo", hi: str = "hi") -> Column:
    return F.aggregate(F.zip_with(F.col(lo), F.col(hi), lambda a, b: b - a), F.lit(1).cast("long"), lambda acc, n: acc * n)


def tiles(placements: DataFrame, shapes: DataFrame) -> DataFrame:
    """(tensor, status, note): whether shards cover each tensor exactly, without overlap.

    placements: tensor, shard, lo, hi; shapes: tensor, shape.
    """
    rows = placements.join(shapes, "tensor")
    inside = F.forall(F.zip_with("lo", "hi", lambda a, b: (a >= 0) & (a < b)), lambda x: x) & F.forall(F.zip_with("hi", "shape", lambda a, b: a <= b), lambda x: x)
    sums = rows.groupBy("tensor").agg(F.sum(_cells()).alias("covered"), F.bool_and(inside).alias("inside"), F.first(F.aggregate("shape", F.lit(1).cast("long"), lambda acc, n: acc * n)).alias("cells"))
    a = placements.select("tensor", F.col("shard").alias("sa"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = placements.select("tensor", F.col("shard").alias("sb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    meet = F.forall(F.zip_with("la", "hb", lambda x, y: x < y), lambda x: x) & F.forall(F.zip_with("lb", "ha", lambda x, y: x < y), lambda x: x)
    clash = a.join(b, "tensor").where((F.col("sa") < F.col("sb")) & meet).groupBy("tensor").agg(F.count("*").alias("clashes"))
    out = sums.join(clash, "tensor", "left")
    note = F.when(~F.col("inside"), "outside the shape").when(F.col("clashes").isNotNull(), "overlap").when(F.col("covered") != F.col("cells"), "gap").otherwise("exact")
    return out.select("tensor", F.when(note == "exact", "valid").otherwise("invalid").alias("status"), note.alias("note"))


def reshard(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tensor, kind): metadata-only where every new shard is a union of whole old ones, else needs-copy."""
    o = old.select("tensor", F.col("shard").alias("so"), F.col("lo").alias("lo_o"), F.col("hi").alias("hi_o"))
    n = new.select("tensor", F.col("shard").alias("sn"), F.col("lo").alias("lo_n"), F.col("hi").alias("hi_n"))
    both = o.join(n, "tensor")
    meet = F.forall(F.zip_with("lo_o", "hi_n", lambda x, y: x < y), lambda x: x) & F.forall(F.zip_with("lo_n", "hi_o", lambda x, y: x < y), lambda x: x)
    within = F.forall(F.zip_with("lo_n", "lo_o", lambda x, y: x <= y), lambda x: x) & F.forall(F.zip_with("hi_o", "hi_n", lambda x, y: x <= y), lambda x: x)
    return both.where(meet).groupBy("tensor").agg(F.when(F.bool_and(within), "metadata-only").otherwise("needs-copy").alias("kind"))


def moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """The boxes to copy: tensor, from, to, lo, hi."""
    o = old.select("tensor", F.col("shard").alias("from"), F.col("lo").alias("lo_o"), F.col("hi").alias("hi_o"))
    n = new.select("tensor", F.col("shard").alias("to"), F.col("lo").alias("lo_n"), F.col("hi").alias("hi_n"))
    both = o.join(n, "tensor").withColumn("lo", F.zip_with("lo_o", "lo_n", lambda a, b: F.greatest(a, b))).withColumn("hi", F.zip_with("hi_o", "hi_n", lambda a, b: F.least(a, b)))
    return both.where(F.forall(F.zip_with("lo", "hi", lambda a, b: a < b), lambda x: x)).select("tensor", "from", "to", "lo", "hi")
