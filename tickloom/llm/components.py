"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for each vertex of ``edges(a, b)``; component is the smallest id reachable.

    Each round takes the smallest label among a vertex and its neighbours and
    then that label's own label, so chains shrink to half and stars end at once.
    Rounds are written to the shared folder; joins are between plain exchanges,
    so a hot vertex can be split, and minima are pre-aggregated.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("id"), F.least("a", "_least").alias("component")), "labels")
    for _ in range(ROUNDS):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").select(F.col("a").alias("id"), "component")
        best = near.union(labels.select("id", "component")).groupBy("id").agg(F.min("component").alias("component"))
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("_next"))
        new = materialise(best.join(hop, "component", "left").select("id", F.least("component", F.coalesce("_next", "component")).alias("component")), "labels")
        changed = not new.join(labels.withColumnRenamed("component", "_old"), "id").where("component <> _old").isEmpty()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
