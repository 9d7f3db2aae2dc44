"""Connected components of an edge table, with bounded work in any task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import small_side, stage


def components(edges: DataFrame, what: str) -> DataFrame:
    """edges(a long, b long) to (node, component): the least node of each component.

    Labels go down along edges to the least neighbour's, then jump to their label's label; each round is written
    to the shared folder. Rounds grow with the logarithm of the longest shortest path. No edges: no rows.
    """
    col = F.col
    both = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b")).distinct()
    both = stage(both, f"{what}-edges", few=True)
    labels = stage(both.groupBy(col("a").alias("node")).agg(F.min("b").alias("component")), f"{what}-labels", few=True)
    while True:
        known = small_side(labels.select(col("node").alias("b"), col("component").alias("of_b")), 32)
        low = both.join(known, "b").groupBy(col("a").alias("node")).agg(F.min("of_b").alias("low"))
        low = stage(low, f"{what}-low", few=True)
        jump = small_side(low.select(col("node").alias("low"), col("low").alias("lower")), 32)
        new = low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("component"))
        new = stage(new, f"{what}-labels", few=True)
        old = small_side(labels.select("node", col("component").alias("was")), 32)
        if not new.join(old, "node").where(col("component") != col("was")).limit(1).count():
            return new
        labels = new
