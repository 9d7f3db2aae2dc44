"""Alert thresholds as finite-sample order statistics. A score alerts if it is above the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.operators.ranking import count_below, running_sums

TIGHT = 1e-12


def rank_of(n: Column, rate: Column) -> Column:
    return F.ceil((n.cast("double") + 1.0) * (F.lit(1.0) - rate)).cast("long")


def thresholds(benign: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """decisions (keys, target_rate, ...) with n_cal and threshold from benign (keys, score).

    The k-th least of n scores, k = ceil((n + 1)(1 - rate)); +inf if the rate is 0, there are no scores or k > n;
    -inf if k < 1. Scores are counted by value and summed along, so equal ones cost one row; a value is the order
    statistic of the ranks that its own rows take up, found by binary search among the ranks asked of its group.
    Ranks are one array a group: decisions are a table of devices times rates.
    """
    keys = list(keys)
    known = benign.where(F.col("score").isNotNull())
    sizes = known.groupBy(*keys).agg(F.count("score").alias("n_cal"))
    asked = decisions.join(sizes, keys, "left").withColumn("n_cal", F.coalesce("n_cal", F.lit(0).cast("long")))
    asked = asked.withColumn("__k", rank_of(F.col("n_cal"), F.col("target_rate")))
    ranks = asked.groupBy(*keys).agg(F.array_sort(F.collect_set("__k")).alias("__ks"))
    counts = known.groupBy(*keys, "score").agg(F.count("*").alias("__c"))
    at = running_sums(counts, keys, "score", {"__before": "__c"}).join(F.broadcast(ranks), keys)
    low, high = (count_below(F.col("__ks"), x + 1, 1 << 20) for x in (F.col("__before"), F.col("__before") + F.col("__c")))
    found = at.withColumns({"__lo": low, "__hi": high}).where(F.col("__hi") > F.col("__lo"))
    found = found.select(*keys, F.explode(F.slice("__ks", F.col("__lo") + 1, F.col("__hi") - F.col("__lo"))).alias("__k"), F.col("score").alias("__score"))
    out = asked.join(found, [*keys, "__k"], "left")
    value = F.when((F.col("target_rate") <= TIGHT) | (F.col("n_cal") == 0) | (F.col("__k") > F.col("n_cal")), F.lit(float("inf"))).when(F.col("__k") < 1, F.lit(float("-inf"))).otherwise(F.col("__score"))
    return out.withColumn("threshold", value).drop("__k", "__score")


def minimum_resolvable_rate(n: Column) -> Column:
    return F.when(n > 0, F.lit(1.0) / (n + 1))
