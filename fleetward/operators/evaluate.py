"""Metrics of thresholds on test rows: per device and subtype, and for the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetward.operators.calibrate import TIGHT, thresholds
from fleetward.operators.ranking import running_sums
from fleetward.staging import measured

CALIBRATION = ("benign_frontier", "benign_final_cal")


def final_thresholds(scores: DataFrame, decisions: DataFrame, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Decisions calibrated on the pooled frontier and final calibration rows."""
    return thresholds(scores.where(F.col("split").isin(*CALIBRATION)).select(*keys, "score"), decisions, keys)


def evaluate(scores: DataFrame, calibrated: DataFrame, keys: tuple[str, ...] = ("client_id",), by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of keys, by and attack subtype: tp, fn, recall, and the device's fp, tn, fpr.

    by: further columns of calibrated (a policy, a budget) for which thresholds differ. Thresholds are broadcast to
    the test rows if they are few enough.
    """
    group = [*keys, *by]
    test = scores.where(F.col("split").isin("benign_test", "attack_test")).select(*keys, "label", "attack_subtype", "score")
    hit = test.join(measured(calibrated.select(*group, "threshold", "target_rate", "n_cal"), "calibrated", 64 + 32 * len(group)), list(keys))
    alert = (F.col("score") > F.col("threshold")) & ~F.isnan("score")
    one = hit.groupBy(*group, "label", "attack_subtype").agg(F.count_if(alert).alias("alerts"), F.count("*").alias("n"), F.max("threshold").alias("threshold"), F.max("target_rate").alias("target_rate"), F.max("n_cal").alias("n_cal"))
    of = Window.partitionBy(*group)
    benign = F.col("label") == "benign"
    fp = F.coalesce(F.sum(F.when(benign, F.col("alerts"))).over(of), F.lit(0))
    nb = F.coalesce(F.sum(F.when(benign, F.col("n"))).over(of), F.lit(0))
    out = one.withColumns({"fp": fp, "n_benign": nb}).where(F.col("label") == "attack")
    return out.select(
        *group, "attack_subtype", "target_rate", "threshold", "n_cal", F.col("alerts").alias("tp"), (F.col("n") - F.col("alerts")).alias("fn"), (F.col("alerts") / F.col("n")).alias("recall"),
        "fp", (F.col("n_benign") - F.col("fp")).alias("tn"), F.when(F.col("n_benign") > 0, F.col("fp") / F.col("n_benign")).otherwise(0.0).alias("fpr"),
    )


def per_client(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Client rows: macro recall over subtypes, fpr, F1 and balanced accuracy from summed counts."""
    tp, fn = F.sum("tp"), F.sum("fn")
    out = results.groupBy(*by, "client_id").agg(F.avg("recall").alias("macro_recall"), F.first("fpr").alias("fpr"), F.first("fp").alias("fp"), F.first("tn").alias("tn"), tp.alias("tp"), fn.alias("fn"))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    balanced = F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2)
    return out.withColumns({"f1": f1, "balanced_accuracy": balanced})


def fleet(clients: DataFrame, weights: DataFrame, budget: float | None = None, by: tuple[str, ...] = (), complete: bool = False) -> DataFrame:
    """One row for each of by: macro and worst recall, weighted fpr, usage and violation of the budget, pooled recall, F1.

    budget: a number, or None if by has the column budget. complete: each of by must have exactly the clients that
    have weights, or reading the result is an error; else clients without a weight are left out.
    """
    from fleetward.operators.checks import covering

    b = F.lit(float(budget)) if budget is not None else F.col("budget")
    # Weights are one row a device: Spark broadcasts them by their size, or joins by shuffle.
    both = covering(clients, weights, ["client_id"], list(by), "evaluation") if complete else clients.join(weights, "client_id")
    out = both.groupBy(*by).agg(
        F.avg("macro_recall").alias("macro_recall"), F.min("macro_recall").alias("worst_recall"), F.sum(F.col("weight") * F.col("fpr")).alias("fleet_fpr"),
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("pooled_recall"), F.avg("f1").alias("macro_f1"), F.avg("balanced_accuracy").alias("balanced_accuracy"),
    )
    usage = F.when(b > TIGHT, F.col("fleet_fpr") / b)
    out = out.withColumn("usage", usage)
    return out.withColumn("violation", F.when(F.col("usage").isNotNull(), F.greatest(F.lit(0.0), F.col("usage") - 1)))


def dispersion(clients: DataFrame) -> DataFrame:
    """One row: median, interquartile range, extremes and coefficient of variation of the clients' fpr."""
    out = clients.agg(F.percentile("fpr", F.lit(0.5)).alias("median"), (F.percentile("fpr", F.lit(0.75)) - F.percentile("fpr", F.lit(0.25))).alias("iqr"), F.min("fpr").alias("least"), F.max("fpr").alias("most"), F.avg("fpr").alias("mean"), F.stddev_pop("fpr").alias("sd"))
    return out.select("median", "iqr", "least", "most", F.when(F.col("mean") > TIGHT, F.col("sd") / F.col("mean")).alias("cv"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row: Gini coefficient, 0 if all values are 0, null without any; by ranks, from a table of one row a client."""
    return gini_by(values, column, [])


def gini_by(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """gini() for each of by."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    ranked = values.select(*by, F.col(column).cast("double").alias("x"), F.row_number().over(w.orderBy(column)).alias("i"), F.count("*").over(w).alias("n"))
    out = ranked.groupBy(*by).agg(F.sum(F.col("i") * F.col("x")).alias("ix"), F.sum("x").alias("x"), F.max("n").alias("n"))
    return out.select(*by, F.when(F.col("x") > 0, 2 * F.col("ix") / (F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n")).when(F.col("x").isNotNull(), 0.0).alias("gini"))


def score_counts(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Benign and attack rows for each distinct score: what the areas below are computed from."""
    return scores.groupBy(*keys, "score").agg(F.count_if(F.col("label") == "benign").alias("b"), F.count_if(F.col("label") == "attack").alias("a"))


def auroc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve by average ranks. Rows of equal score are one before any window."""
    counts = score_counts(scores, keys)
    counts = running_sums(counts, keys, "score", {"below": "b"})
    out = counts.withColumn("wins", F.col("a") * (F.col("below") + F.col("b") / 2)).groupBy(*keys).agg(F.sum("wins").alias("wins"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return out.select(*keys, (F.col("wins") / (F.col("a") * F.col("b"))).alias("auroc"))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: added up to 32 terms, by Euler and Maclaurin's series beyond."""
    x = F.greatest(n, F.lit(32.0))
    series = F.log(x) + 0.57721566490153286 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6)))
    short = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.lit(0.0), lambda s, i: s + F.when(i <= n, 1.0 / i).otherwise(0.0))
    return F.when(n <= 32, short).otherwise(series)


def invariant_areas(areas: DataFrame, keys: list[str], value: str = "auroc", by: str = "policy") -> DataFrame:
    """areas (keys, by, value) to (keys, spread): an error where the policies' areas differ, as thresholds can't move them."""
    out = areas.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    told = F.when(spread < TIGHT, spread).otherwise(F.raise_error(F.concat(F.lit(f"{value} differs between values of {by} by "), spread.cast("string"))))
    return out.select(*keys, F.when(F.col("__lo").isNotNull(), told).alias("spread"))


def operating_points(results: DataFrame, policy: str, budget_id: str) -> DataFrame:
    """(client_id, target_rate, threshold, fpr, macro_recall): a policy's points at one budget, averaged over seeds.

    results (seed, budget_id, policy, client_id, attack_subtype, ...): what is said of a client is the same in each
    of its rows, so the first by subtype stands for all.
    """
    own = results.where((F.col("policy") == policy) & (F.col("budget_id") == budget_id))
    one = own.groupBy("seed", "client_id").agg(F.avg("recall").alias("macro_recall"), *(F.min_by(c, "attack_subtype").alias(c) for c in ("target_rate", "threshold", "fpr")))
    return one.groupBy("client_id").agg(*(F.avg(c).alias(c) for c in ("target_rate", "threshold", "fpr", "macro_recall")))


def auprc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the precision-recall curve: trapezoids row by row, score descending, benign rows first among equals.

    Within equal scores the b benign rows leave recall where it is; the a attack rows then step through precision
    (tp + i) / (tp + fp + i), i = 1..a, each step a trapezoid with the point before; their sum has a closed form.
    """
    counts = running_sums(score_counts(scores, keys), keys, "score", {"tp": "a", "fp": "b"}, descending=True)
    out = counts.withColumns({"tp": F.col("tp").cast("double"), "fp": (F.col("fp") + F.col("b")).cast("double")}).where(F.col("a") > 0)
    n, a = F.col("tp") + F.col("fp"), F.col("a").cast("double")
    # The point before the first step: (recall 0, precision 1) at the very start, else the precision after the benign rows.
    first = F.when(n > 0, F.col("tp") / n).otherwise(1.0)
    last = (F.col("tp") + a) / (n + a)
    # Sum of (tp + i) / (n + i) for i = 1..a: a - fp (H(n + a) - H(n)).
    steps = a - F.col("fp") * (harmonic(n + a) - harmonic(n)) + (first - last) / 2
    out = out.withColumn("area", steps).groupBy(*keys).agg(F.sum("area").alias("area"), F.sum("a").alias("a"))
    return out.select(*keys, (F.col("area") / F.col("a")).alias("auprc"))
