"""Report tables: summaries of evaluations in one pass, formatted cells, summary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.operators import infer

#: What a summary averages over seeds, by the name in evaluations.
METRICS = ("macro_recall", "worst_recall", "fleet_fpr", "usage", "violation", "pooled_recall", "macro_f1", "balanced_accuracy", "auroc", "auprc", "gini", "fallback_share")

# Columns of the tables, with the digits of their cells.
PRIMARY_COLUMNS = {"macro recall": ("macro_recall", 4), "worst-client recall": ("worst_recall", 4), "budget usage": ("usage", 3), "federation fpr": ("fleet_fpr", 4)}
SECONDARY_COLUMNS = {
    "pooled recall": ("pooled_recall", 4), "macro f1": ("macro_f1", 4), "balanced accuracy": ("balanced_accuracy", 4), "auroc": ("auroc", 4), "auprc": ("auprc", 4), "false-alert gini": ("gini", 4), "budget violation": ("violation", 3),
}
EXTERNAL_COLUMNS = {"macro recall": ("macro_recall", 4), "worst-client recall": ("worst_recall", 4), "federation fpr": ("fleet_fpr", 4)}
ABSENT = "\N{EM DASH}"


def summaries(evals: DataFrame) -> DataFrame:
    """(level, budget_id, policy, n, means): completed evaluations by budget and policy, by policy, by budget, and all.

    level: cell, policy, budget or all; null where a level has no such key. One pass by grouping sets; metrics that
    evals has none of are null, and nulls are left out of a mean.
    """
    have = [m for m in METRICS if m in evals.columns]
    done = evals.where(F.col("status") == "COMPLETED") if "status" in evals.columns else evals
    budget, policy = F.col("budget_id"), F.col("policy")
    out = done.groupingSets([[budget, policy], [policy], [budget], []], budget, policy).agg(F.grouping_id().alias("__g"), F.count("*").alias("n"), *(F.avg(m).alias(m) for m in have))
    level = F.when(F.col("__g") == 0, "cell").when(F.col("__g") == 1, "budget").when(F.col("__g") == 2, "policy").otherwise("all")
    return out.where(F.col("n") > 0).select(level.alias("level"), "budget_id", "policy", "n", *(F.col(m) if m in have else F.lit(None).cast("double").alias(m) for m in METRICS))


def _cell(column: str, digits: int) -> Column:
    """A number to so many digits, halves as printed by C; a dash where there is none."""
    return F.when(F.col(column).isNull(), F.lit(ABSENT)).otherwise(F.format_string(f"%.{digits}f", F.col(column)))


def _budget_values(budgets: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for k, v in budgets.items() for x in (k, float(v))))


def budget_policy_table(summary: DataFrame, budgets: dict[str, float], columns: dict[str, tuple[str, int]], policies: tuple[str, ...] | None = None) -> DataFrame:
    """(budget, policy, the columns) as text, from the cells of summaries(), by budget's value and policy."""
    value = F.try_element_at(_budget_values(budgets), F.col("budget_id"))
    own = summary.where(F.col("level") == "cell").withColumn("__b", value).where(F.col("__b").isNotNull())
    rank = [F.array_position(F.array(*map(F.lit, policies)), F.col("policy"))] if policies else []
    return own.orderBy("__b", *rank, "policy").select(F.format_string("%.4f", "__b").alias("budget"), "policy", *(_cell(c, d).alias(name) for name, (c, d) in columns.items()))


def external_table(summary: DataFrame, budgets: dict[str, float], policy: str = "macro") -> DataFrame:
    """(budget, macro recall, worst-client recall, federation fpr) of one policy's means over seeds."""
    return budget_policy_table(summary.where(F.col("policy") == policy), budgets, EXTERNAL_COLUMNS).drop("policy")


def rotation_table(spark, rotations: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(variant, validation scope, test scope) of a study's rotations: a protocol, so one row a rotation."""
    return spark.createDataFrame([(k, v, ", ".join(t)) for k, (v, t) in rotations.items()], "variant string, `validation scope` string, `test scope` string")


def population_table(counts: DataFrame) -> DataFrame:
    """(dataset_id, clients, benign, attack, subtypes) of rows (dataset_id, client_id, label, attack_subtype)."""
    attack = F.col("label") == "attack"
    return counts.groupBy("dataset_id").agg(F.count_distinct("client_id").alias("clients"), F.count_if(~attack).alias("benign"), F.count_if(attack).alias("attack"), F.count_distinct("attack_subtype").alias("subtypes"))


def contrast_summary(evals: DataFrame, contrasts: list[tuple[str, str, str]], alpha: float = 0.05, resamples: int = 50_000, seed: int = 0) -> DataFrame:
    """(treatment, baseline, metric, budget_id, included, mean, median, low, high, p, adjusted, rejected) of paired contrasts.

    Each contrast is a family of its budgets for Holm's procedure. included: seeds with a pair.
    """
    out = None
    for treatment, baseline, metric in contrasts:
        diffs = infer.paired_differences(evals, treatment, baseline, metric)
        tests = infer.holm(infer.sign_flip(diffs).select("budget_id", F.col("n").alias("included"), "p"), alpha=alpha)
        spread = infer.bootstrap(diffs, resamples, seed=seed)
        one = tests.join(spread, "budget_id").select(F.lit(treatment).alias("treatment"), F.lit(baseline).alias("baseline"), F.lit(metric).alias("metric"), "budget_id", "included", "mean", "median", "low", "high", "p", "adjusted", "rejected")
        out = one if out is None else out.unionByName(one)
    return out


def budget_cells(evals: DataFrame) -> DataFrame:
    """The summary file's rows: completed cells of seed, budget and policy, in that order."""
    done = evals.where(F.col("status") == "COMPLETED") if "status" in evals.columns else evals
    share = F.col("fallback_share") if "fallback_share" in evals.columns else F.lit(None).cast("double")
    return done.select("seed", F.col("budget_id").alias("budget"), "policy", "macro_recall", F.col("worst_recall").alias("worst_client_recall"), F.col("fleet_fpr").alias("federation_fpr"), F.col("usage").alias("budget_usage"), share.alias("fallback_rate")).orderBy("seed", "budget", "policy")


def with_fallback(evals: DataFrame, allocations: DataFrame) -> DataFrame:
    """evals with fallback_share: of its clients, those that took the fallback rate; 0 for policies without any."""
    shares = allocations.groupBy("seed", "budget_id", "policy").agg(F.avg((F.col("status") == "FALLBACK").cast("double")).alias("fallback_share"))
    return evals.join(shares, ["seed", "budget_id", "policy"], "left").withColumn("fallback_share", F.coalesce("fallback_share", F.lit(0.0)))


def report(evals: DataFrame, budgets: dict[str, float], policies: tuple[str, ...], contrasts: list[tuple[str, str, str]], external: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a report by name: budget_policy_summary, secondary_metrics, statistics, totals and, if there is one, external_replication.

    Evaluations are summed up once for all tables.
    """
    from fleetward.staging import staged

    summary = staged(summaries(evals), "summaries")
    out = {
        "budget_policy_summary": budget_policy_table(summary, budgets, PRIMARY_COLUMNS, policies), "secondary_metrics": budget_policy_table(summary, budgets, SECONDARY_COLUMNS, policies),
        "statistics": contrast_summary(evals, contrasts), "totals": summary.where(F.col("level") != "cell"),
    }
    if external is not None:
        out["external_replication"] = external_table(summaries(external), budgets)
    return out


def write_summary(evals: DataFrame, path: str, most_rows: int = 1_000_000) -> bool:
    """budget_cells() as one CSV file below path; False, and nothing written, without any. A table beyond most_rows is an error."""
    from fleetward.sources.tables import write_csv

    n = budget_cells(evals).limit(most_rows + 1).count()
    if n > most_rows:
        raise ValueError(f"a summary of more than {most_rows} rows is no report table")
    if n:
        write_csv(budget_cells(evals), path)
    return n > 0


def policy_curves(summary: DataFrame, budgets: dict[str, float], metrics: tuple[str, ...] = ("macro_recall", "worst_recall", "usage")) -> DataFrame:
    """(metric, policy, budget, value) behind the figures of policies by budget; cells without a value have no row."""
    own = summary.where(F.col("level") == "cell").withColumn("budget", F.try_element_at(_budget_values(budgets), F.col("budget_id"))).where(F.col("budget").isNotNull())
    return own.unpivot(["policy", "budget"], list(metrics), "metric", "value").where(F.col("value").isNotNull()).select("metric", "policy", "budget", "value")


def figure_data(evals: DataFrame, results: DataFrame, utilities: DataFrame, replicates: DataFrame, heterogeneity: DataFrame, budgets: dict[str, float], treatment: str = "macro", baseline: str = "equal_rate") -> dict[str, DataFrame]:
    """The tables behind a report's figures, by name.

    policy_curves; operating_points of the treatment at the middle budget; utility_curves (client_id, target_rate,
    utility); stability, five numbers of the replicates' rates (client_id, replicate, target_rate) of each client; and
    gain_heterogeneity, each seed's mean gain of the treatment beside its heterogeneity (seed, aggregate).
    """
    from fleetward.operators import evaluate, lookups
    from fleetward.staging import staged

    middle = sorted(budgets, key=budgets.get)[len(budgets) // 2]
    gains = infer.paired_differences(evals, treatment, baseline, "macro_recall").groupBy("seed").agg(F.avg("diff").alias("gain")).where(F.col("gain").isNotNull())
    five = [F.percentile("target_rate", F.lit(q)).alias(n) for q, n in ((0.0, "least"), (0.25, "lower"), (0.5, "median"), (0.75, "upper"), (1.0, "most"))]
    return {
        "policy_curves": policy_curves(staged(summaries(evals), "summaries"), budgets), "operating_points": evaluate.operating_points(results, treatment, middle),
        "utility_curves": utilities.select("client_id", "target_rate", "utility"), "stability": replicates.groupBy("client_id").agg(F.count("*").alias("n"), *five),
        "gain_heterogeneity": lookups.gain_and_heterogeneity(gains, heterogeneity),
    }
