"""Joins of rows with scores, decisions and evidence, with the conditions under which they are errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.operators.checks import require_unique

PLACE = ["source_file", "source_row"]


def score_lookup(rows: DataFrame, scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """rows with the score of their place; rows without one go; two scores of one place are an error."""
    keys = keys or PLACE
    return rows.join(require_unique(scores, keys).select(*keys, "score"), keys)


def timed_scores(timed: DataFrame, scores: DataFrame) -> DataFrame:
    """(client_id, t, score, label, attack_subtype, source_file, source_row) of rows with a device, a time and a score.

    Labels are those of the timed rows, scores those of the score table.
    """
    known = timed.where(F.col("client_id").isNotNull() & (F.trim("client_id") != "") & F.col("t").isNotNull())
    return score_lookup(known, scores).select("client_id", "t", "score", "label", "attack_subtype", *PLACE)


def merge_decisions(population: DataFrame, fallback: DataFrame, optimised: DataFrame) -> DataFrame:
    """(client_id, target_rate, fallback) for every client of the population; one without any decision is an error."""
    both = population.select("client_id").join(fallback.select("client_id", F.col("target_rate").alias("__f")), "client_id", "left")
    both = both.join(optimised.select("client_id", F.col("target_rate").alias("__o")), "client_id", "left")
    rate = F.coalesce("__f", "__o", F.raise_error(F.concat(F.lit("no decision for client "), F.col("client_id"))).cast("double"))
    return both.select("client_id", rate.alias("target_rate"), F.col("__f").isNotNull().alias("fallback"))


def gain_and_heterogeneity(gains: DataFrame, heterogeneity: DataFrame) -> DataFrame:
    """(seed, gain, heterogeneity) of the seeds that both have: gains (seed, gain), heterogeneity (seed, aggregate)."""
    return gains.join(heterogeneity.groupBy("seed").agg(F.avg("aggregate").alias("heterogeneity")), "seed").select("seed", "gain", "heterogeneity")
