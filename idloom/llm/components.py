"""Connected components of an edge table: union-find inside partitions, large and small stars between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idloom.llm.common import saved


def _union_find(batches):
    """(node, root) for each node that is not a root among the edges of one partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in parent]
    rows = [r for r in rows if r[0] != r[1]]
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], names=["u", "v"])


def _contract(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_union_find, "u bigint, v bigint")


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over n edges with u > v. Least neighbours are written before they are joined,
    so that Spark can split the edges of a root with many children."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", most=2 * n)
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = saved(large.union(edges.join(low, "u").select("u", F.col("m").alias("v"))).where("u > v").distinct(), "kept", most=2 * n)
    least = saved(kept.groupBy("u").agg(F.min("v").alias("m")), "least", most=2 * n)
    hung = kept.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b): component is the least node that it reaches.

    Null ends and loops are left out; an empty table gives an empty one. Each round writes its edges to the
    shared folder; the last round changed nothing, which is found by comparing all edges.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    now = saved(_contract(now).distinct(), "edges")
    n = now.count()
    for _ in range(most_rounds):
        if not n:
            break
        before, now = now, saved(_contract(_stars(now, n)).distinct(), "edges", most=2 * n)
        last, n = n, now.count()
        if n == last and now.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError("components: not settled")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
