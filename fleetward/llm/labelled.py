"""Bounded samples of labelled documents, for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """(doc_id, text, y): documents of at most per_class labels of each class, those of least hash of the id.

    Held-out ids, null ids and null labels are never among them. The ids are bounded, so they are broadcast.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    order = F.xxhash64(F.lit(seed), "id")
    picked = [own.where(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    return docs.join(F.broadcast(ids), docs["doc_id"] == ids["id"]).select("doc_id", "text", "y")


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Labels 0 and 1 among those that may be learnt from."""
    y = F.col(label).cast("int")
    row = labels.where(~held_out(F.col("doc_id"))).agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1")).first()
    return int(row["n0"]), int(row["n1"])
