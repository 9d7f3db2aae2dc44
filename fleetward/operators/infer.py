"""Exact paired inference on one row a seed, and acceptance gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIGHT = 1e-12
#: Seeds of a sign-flip test: all 2^n sign vectors are enumerated.
MAX_SEEDS = 10


def paired_differences(evals: DataFrame, treatment: str, baseline: str, metric: str) -> DataFrame:
    """(budget_id, seed, diff): treatment less baseline; diff is null where either is missing."""
    pick = lambda p: F.max(F.when(F.col("policy") == p, F.col(metric)))
    out = evals.where(F.col("policy").isin(treatment, baseline)).groupBy("budget_id", "seed").agg(pick(treatment).alias("t"), pick(baseline).alias("b"))
    return out.select("budget_id", "seed", (F.col("t") - F.col("b")).alias("diff"))


def sign_flip(diffs: DataFrame) -> DataFrame:
    """(budget_id, n, mean, p): share of sign vectors whose mean is at least as far from 0; at most MAX_SEEDS seeds."""
    known = diffs.where(F.col("diff").isNotNull())
    ds = known.groupBy("budget_id").agg(F.array_sort(F.collect_list(F.struct("seed", "diff"))).alias("d"))
    n = F.size("d")
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + x["diff"])
    masks = ds.withColumns({"n": n, "total": total, "checked": F.assert_true(n <= MAX_SEEDS)}).drop("checked")
    masks = masks.withColumn("mask", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, n) - 1"))))
    signed = F.aggregate(F.transform("d", lambda x, i: F.when(F.call_function("shiftright", F.col("mask"), i) % 2 == 1, -x["diff"]).otherwise(x["diff"])), F.lit(0.0), lambda a, x: a + x)
    far = F.abs(signed / F.col("n")) >= F.abs(F.col("total") / F.col("n")) - TIGHT
    return masks.groupBy("budget_id", "n").agg((F.first("total") / F.first("n")).alias("mean"), F.avg(far.cast("double")).alias("p"))


def holm(tests: DataFrame, p: str = "p", order: str = "budget_id", alpha: float = 0.05, family: list[str] | None = None) -> DataFrame:
    """Adds adjusted and rejected by Holm's step-down within family (unset: all rows, a small table)."""
    keys = [F.col(c) for c in family] if family else [F.lit(1)]
    w = Window.partitionBy(*keys).orderBy(p, order)
    left = F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(w) + 1
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = tests.withColumn("__left", left)
    out = out.withColumn("adjusted", F.max(F.least(F.lit(1.0), F.col("__left") * F.col(p))).over(upto))
    return out.withColumn("rejected", F.min((F.col(p) <= F.lit(alpha) / F.col("__left")).cast("int")).over(upto) == 1).drop("__left")


def bootstrap(diffs: DataFrame, resamples: int = 50_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(budget_id, mean, median, low, high): percentile interval of the mean over seeded resamples of a few seeds."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values("seed")["diff"].to_numpy()
        rng = np.random.default_rng(seed)
        means = d[rng.integers(0, len(d), size=(resamples, len(d)))].mean(axis=1)
        low, high = np.percentile(means, [50 * (1 - confidence), 50 * (1 + confidence)])
        return pd.DataFrame({"budget_id": [rows["budget_id"].iat[0]], "mean": [d.mean()], "median": [np.median(d)], "low": [low], "high": [high]})

    return diffs.where(F.col("diff").isNotNull()).groupBy("budget_id").applyInPandas(run, "budget_id string, mean double, median double, low double, high double")


def contrast(evals: DataFrame, treatment: str, baseline: str, metric: str, name: str | None = None) -> DataFrame:
    """(contrast, budget_id, n, excluded, mean, p) of a paired contrast, by budget; excluded: seeds without a pair."""
    diffs = paired_differences(evals, treatment, baseline, metric)
    out = diffs.groupBy("budget_id").agg(F.count_if(F.col("diff").isNull()).alias("excluded"))
    return sign_flip(diffs).join(out, "budget_id").select(F.lit(name or f"{treatment} less {baseline}: {metric}").alias("contrast"), "budget_id", "n", "excluded", "mean", "p")


def primary(evals: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The two primary contrasts by budget, Holm-adjusted within each: macro on macro recall, minimax on worst recall."""
    one = contrast(evals, "macro", "equal_rate", "macro_recall", "macro_recall").unionByName(contrast(evals, "minimax", "equal_rate", "worst_recall", "worst_recall"))
    return holm(one, alpha=alpha, family=["contrast"])


def guardrail(evals: DataFrame) -> DataFrame:
    """What minimax costs in macro recall, by budget; not adjusted."""
    return contrast(evals, "minimax", "equal_rate", "macro_recall", "guardrail")


def policy_means(evals: DataFrame, policy: str, metric: str) -> DataFrame:
    """(budget_id, mean) of a policy; a seed and budget without the policy is an error."""
    cells = evals.groupBy("seed", "budget_id").agg(F.count_if(F.col("policy") == policy).alias("n"))
    lacking = cells.where(F.col("n") == 0).first()
    if lacking:
        raise ValueError(f"seed {lacking['seed']} has no {policy} at {lacking['budget_id']}")
    return evals.where(F.col("policy") == policy).groupBy("budget_id").agg(F.avg(metric).alias("mean"))


def worst_fallback(shares: DataFrame, limit: float) -> DataFrame:
    """One row: the greatest fallback_share of all runs, and whether it is above the limit."""
    return shares.agg(F.max("fallback_share").alias("worst")).withColumn("warning", F.col("worst") > F.lit(float(limit)))


def count_gate(cells: DataFrame, ok: Column, least: int, budgets: int) -> DataFrame:
    """One row: (passed, n_ok, status): at least so many budgets pass; UNAVAILABLE if a budget is missing."""
    out = cells.agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n"))
    status = F.when(F.col("n") < budgets, "UNAVAILABLE").when(F.col("n_ok") >= least, "PASS").otherwise("FAIL")
    return out.select("n_ok", status.alias("status"))


def macro_gate(evals: DataFrame, policy: str, floor: float, least: int, budgets: int) -> DataFrame:
    cells = evals.where(F.col("policy") == policy).groupBy("budget_id").agg(F.avg("macro_recall").alias("m"))
    return count_gate(cells, F.col("m") >= floor, least, budgets)


def minimax_gate(evals: DataFrame, policy: str, baseline: str, floor: float, loss_points: float, least: int, budgets: int) -> DataFrame:
    """Mean worst recall at or above floor, and mean macro recall at most loss_points (percentage points) below the baseline's."""
    of = lambda p, c: F.avg(F.when(F.col("policy") == p, F.col(c)))
    cells = evals.groupBy("budget_id").agg(of(policy, "worst_recall").alias("w"), ((of(policy, "macro_recall") - of(baseline, "macro_recall")) * 100).alias("d"))
    cells = cells.where(F.col("w").isNotNull() & F.col("d").isNotNull())
    return count_gate(cells, (F.col("w") >= floor) & (F.col("d") >= -loss_points), least, budgets)


def compliance(evals: DataFrame, seeds: int, median: float = 1.05, usage: float = 1.10, share: float = 0.9) -> DataFrame:
    """(policy, budget_id, median_usage, share_within, status)."""
    out = evals.groupBy("policy", "budget_id").agg(F.percentile("usage", F.lit(0.5)).alias("median_usage"), F.avg((F.col("usage") <= usage).cast("double")).alias("share_within"), F.count("usage").alias("n"))
    status = F.when(F.col("n") < seeds, "UNAVAILABLE").when((F.col("median_usage") <= median) & (F.col("share_within") >= share), "PASS").otherwise("FAIL")
    return out.select("policy", "budget_id", "median_usage", "share_within", status.alias("status"))


def seed_means(evals: DataFrame) -> DataFrame:
    """(budget_id, policy, n, means): over seeds; nulls are left out of each mean."""
    return evals.groupBy("budget_id", "policy").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in ("macro_recall", "worst_recall", "fleet_fpr", "usage", "violation")))


def stability(rates: DataFrame) -> DataFrame:
    """rates (client_id, replicate, target_rate) to mode (least among equals), its frequency, median, p5, p95, instability."""
    counts = rates.groupBy("client_id", "target_rate").agg(F.count("*").alias("n"))
    mode = counts.groupBy("client_id").agg(F.max(F.struct("n", (-F.col("target_rate")).alias("neg"))).alias("m"), F.sum("n").alias("all"))
    mode = mode.select("client_id", (-F.col("m.neg")).alias("mode_rate"), (F.col("m.n") / F.col("all")).alias("mode_share"))
    spread = rates.groupBy("client_id").agg(*(F.percentile("target_rate", F.lit(q)).alias(n) for q, n in ((0.5, "median"), (0.05, "p5"), (0.95, "p95"))))
    return mode.join(spread, "client_id").withColumn("instability", 1 - F.col("mode_share"))
