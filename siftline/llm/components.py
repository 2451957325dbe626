"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) -> (id, component): the smallest id reachable, for each id of a link.

    Every round takes the smallest label among neighbours, then jumps to the label of that label, which halves the depth of
    a chain.  The edges of a vertex with very many links share a partition of the join only until the adaptive planner
    splits it; they are aggregated before the next shuffle, so that there the vertex costs one row a task.
    Labels live in tables of the shared folder; the driver sees only how many changed.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = settle(both.where("a <> b").distinct(), "edges")
    label = settle(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    for _ in range(max_rounds):
        label_of = label.select("id", "component")
        near = edges.join(label_of, edges.b == label_of.id).groupBy("a").agg(F.min("component").alias("near"))
        low = label_of.join(near, label_of.id == near.a).select("id", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        low = settle(low, "low")
        up = low.select(F.col("id").alias("up"), F.col("low").alias("top"))
        new = settle(low.join(up, low.low == up.up, "left").select("id", F.least("low", F.coalesce("top", "low")).alias("component"), "was"), "labels")
        forget(low, label)
        label = new
        if not new.where("component <> was").limit(1).count():
            forget(edges)
            out = new.select("id", "component")
            out.settled_at = new.settled_at
            return out
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
