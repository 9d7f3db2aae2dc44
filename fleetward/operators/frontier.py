"""Detection-utility curves over a grid of false-positive rates, eligibility and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetward.operators.calibrate import TIGHT, thresholds
from fleetward.operators.ranking import count_below
from fleetward.staging import measured

# A short grid of rates, and the budgets that the long one contains beside its steps.
GRID = (0.0, 0.001, 0.005, 0.01, 0.02, 0.05)
BUDGETS = (0.001, 0.0025, 0.005, 0.01, 0.02)


def long_grid(least: float = 1e-4, most: float = 0.05, steps: int = 201, budgets: tuple[float, ...] = BUDGETS) -> tuple[float, ...]:
    """0, steps that rise by one factor from least to most, and the budgets: 207 rates as it stands."""
    rise = (most / least) ** (1 / (steps - 1))
    return tuple(sorted({0.0, most, *budgets, *(least * rise**k for k in range(steps - 1))}))


def grid_frame(df: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Each client with each rate of the grid."""
    points = F.array(*(F.struct(F.lit(i).alias("grid_ix"), F.lit(float(a)).alias("target_rate")) for i, a in enumerate(grid)))
    return df.select("client_id").distinct().select("client_id", F.inline(points))


def confusions(scores: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(client_id, grid_ix, target_rate, threshold, attack_subtype, tp, fn): frontier scores set the thresholds.

    Thresholds never rise with the rate, so a score alerts from some rate of the grid on. Each row is given the
    number of rates at which it alerts; counts of that number, summed up, are the true positives: one pass, no row
    for each rate. A client's thresholds travel as one array; the table is broadcast if clients are few enough.
    """
    benign = scores.where(F.col("split") == "benign_frontier").select("client_id", "score")
    cut = thresholds(benign, grid_frame(scores, grid))
    arrays = cut.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("grid_ix", "target_rate", "threshold"))).alias("cuts"))
    arrays = arrays.withColumn("falling", F.reverse(F.transform("cuts", lambda c: c["threshold"])))
    attack = scores.where(F.col("split") == "attack_validation").select("client_id", "attack_subtype", "score")
    seen = attack.join(measured(arrays, "cuts", 64 + 48 * len(grid)), "client_id").withColumn("hits", F.when(F.isnan("score"), 0).otherwise(count_below(F.col("falling"), F.col("score"), len(grid))))
    counts = seen.groupBy("client_id", "attack_subtype", "hits").agg(F.count("*").alias("n"), F.any_value("cuts").alias("cuts"))
    total = F.sum("n").over(Window.partitionBy("client_id", "attack_subtype"))
    spread = counts.withColumn("total", total).select("client_id", "attack_subtype", "hits", "n", "total", F.inline("cuts"))
    tp = F.sum(F.when(F.col("hits") >= len(grid) - F.col("grid_ix"), F.col("n")).otherwise(0)).alias("tp")
    out = spread.groupBy("client_id", "grid_ix", "target_rate", "threshold", "attack_subtype").agg(tp, F.max("total").alias("total"))
    return out.select("client_id", "grid_ix", "target_rate", "threshold", "attack_subtype", "tp", (F.col("total") - F.col("tp")).alias("fn"))


def eligibility(conf: DataFrame, min_client: int = 100, min_subtypes: int = 2, min_rows: int = 50) -> DataFrame:
    """(client_id, n_rows, n_subtypes, eligible): rows of all subtypes, subtypes with enough rows."""
    n = F.col("tp") + F.col("fn")
    one = conf.where(F.col("grid_ix") == 0)
    out = one.groupBy("client_id").agg(F.sum(n).alias("n_rows"), F.count_if(n >= min_rows).alias("n_subtypes"))
    return out.withColumn("eligible", (F.col("n_rows") >= min_client) & (F.col("n_subtypes") >= min_subtypes))


def utilities(conf: DataFrame, min_rows: int = 50, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """(keys, grid_ix, target_rate, utility, utility_variance) over subtypes with enough rows."""
    n = (F.col("tp") + F.col("fn")).cast("double")
    p = F.col("tp") / n
    out = conf.where(F.col("tp") + F.col("fn") >= min_rows).groupBy(*keys, "grid_ix", "target_rate")
    return out.agg(F.avg(p).alias("utility"), (F.sum(p * (1 - p) / n) / F.pow(F.count("*"), F.lit(2))).alias("utility_variance"))


def resolution_guard(points: DataFrame, n_cal: DataFrame, factor: float = 1.0) -> DataFrame:
    """Adds forbidden: rates above 0 that the calibration sample cannot resolve, rate < factor / (n_cal + 1)."""
    out = points.join(F.broadcast(n_cal), "client_id")
    return out.withColumn("forbidden", (F.col("target_rate") > TIGHT) & (F.col("target_rate") < F.lit(float(factor)) / (F.col("n_cal") + 1)))


def fallback_budget(elig: DataFrame, weights: DataFrame, budget: float, cap: float = 0.05) -> DataFrame:
    """One row: fallback clients' rate, what they reserve, what remains, the share of fallback clients."""
    rate = min(budget, cap)
    both = elig.join(weights, "client_id")
    out = both.agg(F.sum(F.when(~F.col("eligible"), F.col("weight") * rate).otherwise(0.0)).alias("reserved"), F.avg((~F.col("eligible")).cast("double")).alias("fallback_share"))
    return out.select(F.lit(rate).alias("fallback_rate"), "reserved", F.greatest(F.lit(0.0), F.lit(float(budget)) - F.col("reserved")).alias("remaining"), "fallback_share")


def _everyone() -> Window:
    return Window.partitionBy(F.lit(1))


def equal_weights(clients: DataFrame) -> DataFrame:
    return clients.select("client_id", (F.lit(1.0) / F.count("*").over(_everyone())).alias("weight"))


def count_weights(counts: DataFrame) -> DataFrame:
    """(client_id, n) to shares."""
    return counts.select("client_id", (F.col("n") / F.sum("n").over(_everyone())).alias("weight"))


def subset_weights(weights: DataFrame, population: DataFrame) -> DataFrame:
    """The weights of a population's clients, as they are."""
    return weights.join(population.select("client_id").distinct(), "client_id", "left_semi")


def weighted_cost(decisions: DataFrame, weights: DataFrame, budget: float) -> DataFrame:
    """One row: the decisions' weighted rate, and whether it is within the budget."""
    out = decisions.join(weights, "client_id").agg(F.sum(F.col("weight") * F.col("target_rate")).alias("cost"))
    return out.withColumn("feasible", F.col("cost") <= F.lit(float(budget)) + TIGHT)


def payload(util: DataFrame, candidates: int, envelope: int = 68, value: int = 4) -> DataFrame:
    """(client_id, payload, utility_bytes, complete): bytes of a client's curve; complete if it has every candidate."""
    out = util.groupBy("client_id").agg(F.count("*").alias("n"))
    return out.select("client_id", (F.lit(envelope) + value * F.col("n")).alias("payload"), (value * F.col("n")).alias("utility_bytes"), (F.col("n") == candidates).alias("complete"))


def gamma_weights(weights: DataFrame, gamma: Column | float) -> DataFrame:
    g = F.pow("weight", F.lit(gamma) if isinstance(gamma, float) else gamma)
    return weights.select("client_id", (g / F.sum(g).over(_everyone())).alias("weight"))


def heterogeneity(util: DataFrame) -> DataFrame:
    """(grid_ix, target_rate, spread, mean_spread): population deviation of utilities across clients."""
    out = util.groupBy("grid_ix", "target_rate").agg(F.stddev_pop("utility").alias("spread"), F.count("*").alias("n")).where(F.col("n") > 1)
    return out.select("grid_ix", "target_rate", "spread", F.avg("spread").over(_everyone()).alias("mean_spread"))
