"""Merging model deltas, and adapters over tensors by name."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floatsem as S
from ..functions.chacha import uniforms
from ..functions.patterns import to_regex
from ..tensor import TensorRef, size
from .contract import matmul
from .elementwise import add, combine, mul, scale
from .structure import reshape, transpose


def _stacked(deltas: Sequence[TensorRef]) -> DataFrame:
    out = None
    for k, d in enumerate(deltas):
        part = d.cells().withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


#: Steps that a range of magnitudes is cut into at a time.
STEPS = 1 << 12


def _least_kept(df: DataFrame, deltas: int, keep: int) -> list[float]:
    """The ``keep``-th largest m of each k below ``deltas``, by exact rank.

    The range that holds that rank is narrowed by counts over equal steps until
    one value is left; the driver sees a row for each delta and cut.
    """
    if keep < 1:
        return [S.INF] * deltas
    low, high, above = [0.0] * deltas, [S.INF] * deltas, [0] * deltas
    ends = df.groupBy("k").agg(F.min("m").alias("low"), F.max("m").alias("high")).collect()
    for r in ends:
        low[r.k], high[r.k] = r.low, r.high
    while any(a < b for a, b in zip(low, high, strict=True)):
        at = {name: F.element_at(F.array(*(S.lit(x) for x in values)), F.col("k") + 1) for name, values in (("low", low), ("high", high), ("above", above))}
        inside = df.where((F.col("m") >= at["low"]) & (F.col("m") <= at["high"]))
        step = F.floor((F.col("m") - at["low"]) / F.nullif(at["high"] - at["low"], S.lit(0)) * STEPS)
        inside = inside.withColumn("step", F.coalesce(F.least(step, F.lit(STEPS - 1)), F.lit(0)).cast("int"))
        counts = inside.groupBy("k", "step").agg(F.count("*").alias("n"), F.min("m").alias("low"), F.max("m").alias("high"))
        over = Window.partitionBy("k").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)  # STEPS rows at most
        counts = counts.withColumn("before", at["above"] + F.coalesce(F.sum("n").over(over), F.lit(0)))
        for r in counts.where((F.col("before") < keep) & (F.col("before") + F.col("n") >= keep)).collect():
            low[r.k], high[r.k], above[r.k] = r.low, r.high, int(r.before)
    return high


def ties(deltas: Sequence[TensorRef], density: float, weights: Sequence[float] | None = None) -> TensorRef:
    """Trim each delta to its largest parts, elect a sign per cell, average what agrees.

    The trim keeps ``ceil(n * density)`` cells and all that tie with the last
    of them.  Equal sums of both signs elect the positive one.
    """
    n = size(deltas[0].shape)
    keep = math.ceil(n * density)
    weights = list(weights or [1.0] * len(deltas))
    df = _stacked(deltas)
    w = F.element_at(F.array(*(S.lit(x) for x in weights)), F.col("k") + 1)
    least = _least_kept(df.select("k", F.abs("v").alias("m")), len(deltas), keep)
    kept = df.where(F.abs("v") >= F.element_at(F.array(*(S.lit(x) for x in least)), F.col("k") + 1)).withColumn("w", w).withColumn("x", F.col("v") * F.col("w"))
    sums = kept.groupBy("pos").agg(
        F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("x"))), S.lit(0)).alias("up"),
        F.coalesce(F.sum(F.when(F.col("x") < 0, -F.col("x"))), S.lit(0)).alias("down"),
        F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("w"))), S.lit(0)).alias("nu"),
        F.coalesce(F.sum(F.when(F.col("x") < 0, F.col("w"))), S.lit(0)).alias("nd"),
    )
    up = F.col("up") >= F.col("down")
    v = F.when(up & (F.col("nu") != 0), F.col("up") / F.nullif(F.col("nu"), S.lit(0))).when(~up & (F.col("nd") != 0), -F.col("down") / F.nullif(F.col("nd"), S.lit(0))).otherwise(S.lit(0))
    grid = deltas[0].cells().select("pos")
    return deltas[0].with_cells(grid.join(sums.select("pos", v.alias("v")), "pos", "left").select("pos", F.coalesce("v", S.lit(0)).alias("v")))


def dare(deltas: Sequence[TensorRef], drop: float, seed: int = 0) -> TensorRef:
    """Drop cells by a keyed draw at rate ``drop``, rescale the rest, and add up."""
    if not 0 <= drop < 1:
        raise ValueError(f"drop rate {drop}")

    @F.arrow_udf("double")
    def draw(pos: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array(uniforms(seed, pos.to_numpy(zero_copy_only=False), k.to_numpy(zero_copy_only=False)))

    df = _stacked(deltas).withColumn("u", draw("pos", F.col("k").cast("long")))
    v = F.when(F.col("u") >= drop, F.col("v") / (1 - drop)).otherwise(S.lit(0))
    return deltas[0].with_cells(df.groupBy("pos").agg(F.sum(v).alias("v")))


def slerp(a: TensorRef, b: TensorRef, t: float, straight: float = 1e-6) -> TensorRef:
    """Spherical interpolation; a straight line where a norm is zero or the two are parallel."""
    both = a.cells().withColumnRenamed("v", "x").join(b.cells().withColumnRenamed("v", "y"), "pos")
    sums = both.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    product = F.sqrt("xx") * F.sqrt("yy")
    cosine = F.when(product > 0, F.greatest(S.lit(-1), F.least(S.lit(1), F.col("xy") / F.nullif(product, S.lit(0)))))
    angle = F.acos(cosine)
    line = angle.isNull() | (F.abs(F.sin(angle)) < straight)
    sine = F.nullif(F.sin(angle), S.lit(0))
    ca = F.when(line, S.lit(1 - t)).otherwise(F.sin(S.lit(1 - t) * angle) / sine)
    cb = F.when(line, S.lit(t)).otherwise(F.sin(S.lit(t) * angle) / sine)
    factors = sums.select(ca.alias("ca"), cb.alias("cb"))  # one row
    out = both.crossJoin(F.broadcast(factors)).select("pos", (F.col("x") * F.col("ca") + F.col("y") * F.col("cb")).alias("v"))
    return a.with_cells(out)


def parallel_sum(deltas: Sequence[TensorRef], weights: Sequence[float] | None = None) -> TensorRef:
    """Weighted sum of deltas of one base."""
    weights = list(weights or [1.0] * len(deltas))
    w = F.element_at(F.array(*(S.lit(x) for x in weights)), F.col("k") + 1)
    return deltas[0].with_cells(_stacked(deltas).groupBy("pos").agg(F.sum(F.col("v") * w).alias("v")))


# -- adapters ------------------------------------------------------------------------


def lora(base: TensorRef, a: TensorRef, b: TensorRef, alpha: float, rank: int) -> TensorRef:
    """base + (alpha / rank) * B A."""
    return add(base, scale(matmul(b, a), alpha / rank))


def adalora(base: TensorRef, p: TensorRef, lam: TensorRef, q: TensorRef) -> TensorRef:
    """base + P diag(lambda) Q."""
    return add(base, matmul(mul(p, reshape(lam, (1, -1))), q))


def vera(base: TensorRef, a: TensorRef, b: TensorRef, d: TensorRef, out: TensorRef) -> TensorRef:
    """base + diag(out) B diag(d) A with shared A and B."""
    inner = mul(a, reshape(d, (-1, 1)))
    return add(base, mul(matmul(b, inner), reshape(out, (-1, 1))))


def loha(base: TensorRef, a1: TensorRef, b1: TensorRef, a2: TensorRef, b2: TensorRef, alpha: float, rank: int) -> TensorRef:
    """base + (alpha / rank) * (B1 A1) o (B2 A2)."""
    return add(base, scale(mul(matmul(b1, a1), matmul(b2, a2)), alpha / rank))


def ia3(base: TensorRef, vector: TensorRef, *, rows: bool = True) -> TensorRef:
    """Scale rows, or columns, of the base."""
    return mul(base, reshape(vector, (-1, 1) if rows else (1, -1)))


def bitfit(base: TensorRef, bias: TensorRef) -> TensorRef:
    return add(base, bias)


def control_vector(base: TensorRef, direction: TensorRef, strength: float) -> TensorRef:
    return add(base, scale(direction, strength))


METHODS = {"lora": lora, "adalora": adalora, "vera": vera, "loha": loha, "ia3": ia3, "bitfit": bitfit, "control-vector": control_vector}
#: Methods that an elementwise expression of weights cannot state; refused by name.
REFUSED = ("dora", "lokr", "bone", "prefix", "prompt", "p-tuning", "adapter-layers")


def method(name: str):
    if name in REFUSED:
        raise ValueError(f"method {name!r} is refused")
    if name not in METHODS:
        raise ValueError(f"no method {name!r}")
    return METHODS[name]


@dataclass(frozen=True)
class Rule:
    """Which tensors a rule takes: a glob, a regex, a semantic, a role, or axes."""

    method: str
    glob: str | None = None
    regex: str | None = None
    semantic: str | None = None
    role: str | None = None
    axes: tuple[str, ...] | None = None
    bind: dict[str, str] = field(default_factory=dict, hash=False)
    require: bool = False


def attach(tensors: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(name, rule, method, bindings): the first rule that takes each tensor.

    ``tensors`` has name, semantic, role and axes.  Captures of a glob fill
    ``{1}``, ``{2}`` ... in the rule's bindings.
    """
    picked = None
    for number, rule in enumerate(rules):
        method(rule.method)
        pattern = to_regex(rule.glob) if rule.glob else rule.regex or ".*"
        ok = F.col("name").rlike(f"^(?:{pattern})$" if rule.glob else pattern)
        if rule.semantic:
            ok = ok & (F.col("semantic") == rule.semantic)
        if rule.role:
            ok = ok & (F.col("role") == rule.role)
        if rule.axes:
            ok = ok & (F.col("axes") == F.array(*(F.lit(a) for a in rule.axes)))
        names = []
        for key, template in sorted(rule.bind.items()):
            value = F.lit(template)
            for k in range(1, pattern.count("(") + 1):
                if f"{{{k}}}" in template:
                    value = F.replace(value, F.lit(f"{{{k}}}"), F.regexp_extract("name", pattern, k))
            names += [F.lit(key), value]
        bound = F.create_map(*names) if names else F.create_map().cast("map<string,string>")
        part = F.when(ok, F.struct(F.lit(number).alias("rule"), F.lit(rule.method).alias("method"), bound.alias("bindings")))
        picked = part if picked is None else F.coalesce(picked, part)
    return tensors.withColumn("p", picked).where("p is not null").select("name", "p.rule", "p.method", "p.bindings")


def check(attached: DataFrame, adapter_tensors: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings (finding, subject): bindings without a tensor, tensors unused, required rules unmatched."""
    bound = attached.select("name", F.explode(F.map_values("bindings")).alias("tensor"))
    missing = bound.join(adapter_tensors.select(F.col("name").alias("tensor")), "tensor", "left_anti").select(F.lit("R-A01").alias("finding"), F.col("tensor").alias("subject"))
    unused = adapter_tensors.select(F.col("name").alias("subject")).join(bound.select(F.col("tensor").alias("subject")), "subject", "left_anti").select(F.lit("R-A02").alias("finding"), "subject")
    spark = attached.sparkSession
    needed = spark.createDataFrame([(k,) for k, r in enumerate(rules) if r.require] or [], "rule int")
    idle = needed.join(attached.select("rule"), "rule", "left_anti").select(F.lit("R-A03").alias("finding"), F.col("rule").cast("string").alias("subject"))
    return missing.unionByName(unused).unionByName(idle)


def compose_sequential(base: TensorRef, steps) -> TensorRef:
    """Apply functions of a tensor one after another."""
    for step in steps:
        base = step(base)
    return base
