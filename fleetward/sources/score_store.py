"""Scores by place: a table in buckets of (client_id, source_file, source_row), sorted by them within each.

Places are hashed whole, so no client or file makes a bucket larger than others.

Rows that ask for the score of their place are dealt to the same buckets and meet the scores where
they lie: the scores, of which there are as many as there are rows on record, are never shuffled
or sorted for a lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ["client_id", "source_file", "source_row"]
BUCKETS = 64


def write_store(scores: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes scores (client_id, source_file, source_row, score, ...) below path as the table name, replacing what is there.

    Rows are dealt to their buckets first, so each bucket is one sorted file.
    """
    rows = scores.repartition(buckets, *PLACE)
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, *PLACE).sortBy(*PLACE).saveAsTable(name)


def open_store(spark: SparkSession, name: str, path: str, columns: str, buckets: int = BUCKETS) -> DataFrame:
    """The store below path, as the table name of this session's catalog; columns: its schema, as DDL."""
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(PLACE)}) SORTED BY ({', '.join(PLACE)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def lookup(rows: DataFrame, store: DataFrame, value: str = "score", how: str = "inner") -> DataFrame:
    """rows (client_id, source_file, source_row, ...) with the score of their place; those without one go, or are null if how is left.

    Two scores of one place are an error, found where they are read. A row whose place is null has no score.
    """
    one = F.when(F.count("*") == 1, F.first(value)).otherwise(F.raise_error(F.concat(F.lit("several scores of "), F.concat_ws("/", *PLACE))))
    own = store.groupBy(*PLACE).agg(one.alias(value))
    return rows.hint("shuffle_merge").join(own, PLACE, how)


def timed_lookup(timed: DataFrame, store: DataFrame) -> DataFrame:
    """(client_id, t, score, label, attack_subtype, source_file, source_row) of rows with a device, a time and a score."""
    known = timed.where(F.col("client_id").isNotNull() & (F.trim("client_id") != "") & F.col("t").isNotNull())
    return lookup(known, store).select("client_id", "t", "score", "label", "attack_subtype", "source_file", "source_row")
