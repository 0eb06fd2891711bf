"""Connected components by alternating large and small stars.

Before the first round each partition joins what its own edges connect, a
bounded number of edges at a time, which shortens chains and drops edges that
say nothing new.  Each round is two joins and two aggregations over the edge
table, which is written to the shared folder after the round, and then the one
before is deleted.  The number of rounds grows with the logarithm of the longest
chain, and ends early where the edges left fit one task's bound.  No node's
neighbours are ever gathered.

Defined cases: an edge with a null is left out, loops and repeated edges say
nothing, and no edges give no nodes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged

#: Edges that a task joins in memory at a time.
CHUNK_EDGES = 1 << 17


def _local(batches):
    """Edges from each node to the smallest one that a chunk of edges connects it to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def out():
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])

    n = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            p, q = find(a), find(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
        n += batch.num_rows
        if n >= CHUNK_EDGES:
            yield out()
            parent.clear()
            n = 0
    yield out()


def _largest_first(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, the larger node first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours to the smallest one.

    A large star moves a node's larger neighbours, a small star its smaller
    ones and the node itself.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    moved = both.join(least, "a")
    if large:
        return _largest_first(moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")))
    own = least.select("a", F.col("least").alias("b"))
    return _largest_first(moved.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own))


def components(edges: DataFrame, *, rounds: int = 60, nodes: int | None = None) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node it reaches.

    ``nodes``, where known, bounds the nodes; it sizes the first table.
    """
    given = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = staged(_largest_first(given.mapInArrow(_local, "a long, b long")), "edges", rows=nodes)
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        if mark[0] <= CHUNK_EDGES:  # few enough for one task, which joins them for good
            before, now = now, staged(now.coalesce(1).mapInArrow(_local, "a long, b long"), "edges")
            release(before)
            break
        before, now = now, staged(_stars(_stars(now, True), False), "edges", rows=mark[0])
        release(before)
        mark, old = _mark(now), mark
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)


def _mark(edges: DataFrame) -> tuple:
    """How many edges there are, and a sum over them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
