"""The benchmark tables seen as observations of a fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (client_id, label, attack_subtype, score, ordinal, t, seed)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.pmod("user_id", F.lit(5))
    attack = F.col("event_type").isin("error", "purchase")
    shift = F.when(F.col("event_type") == "error", 100 + 50 * k).when(F.col("event_type") == "purchase", 50 + 40 * k).otherwise(0)
    return e.select(
        F.concat(F.lit("c"), k.cast("string")).alias("client_id"), F.when(attack, "attack").otherwise("benign").alias("label"), F.when(attack, F.col("event_type")).alias("attack_subtype"),
        (F.col("value") + shift).alias("score"), F.col("event_id").alias("ordinal"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.pmod("event_id", F.lit(3)).alias("seed"),
    )


def large_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as (client_id, label, attack_subtype, score, ordinal): nine devices, four attack subtypes."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.pmod("l_suppkey", F.lit(9))
    benign = F.col("l_returnflag") == "N"
    return x.select(
        F.concat(F.lit("s"), k.cast("string")).alias("client_id"), F.when(benign, "benign").otherwise("attack").alias("label"),
        F.when(~benign, F.lower(F.concat("l_returnflag", F.lit("_"), "l_linestatus"))).alias("attack_subtype"),
        (F.col("l_extendedprice") / F.lit(1000.0) + F.when(benign, F.lit(0)).otherwise(20 + 8 * k)).alias("score"), F.col("l_orderkey").alias("ordinal"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (client_id, row, x): x array<double>."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.concat(F.lit("e"), F.col("label").cast("string")).alias("client_id"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("x"))
