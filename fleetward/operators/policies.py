"""How a fleet's false-positive budget is divided: one target rate a device."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetward.operators.calibrate import TIGHT
from fleetward.operators.ranking import running_sums
from fleetward.plans import solver

CAP = 0.05


def equal_rate(clients: DataFrame, budget: float, cap: float = CAP) -> DataFrame:
    if budget > cap:
        raise ValueError(f"budget {budget} is above the cap {cap} of a device")
    return clients.select("client_id", F.lit(float(budget)).alias("target_rate"))


def equal_alert(weights: DataFrame, budget: float, cap: float = CAP) -> DataFrame:
    """equal_alerts() at one budget: (client_id, target_rate)."""
    return equal_alerts(weights, {"b": budget}, cap).select("client_id", "target_rate")


def equal_alerts(weights: DataFrame, budgets: dict[str, float], cap: float = CAP) -> DataFrame:
    """(budget_id, budget, client_id, target_rate) of equal weighted alerts: the largest c with sum(min(c, cap w)) <= budget;
    rate min(c / w, cap).

    The sum is piecewise linear in c: with devices by rising weight, the first that c does not fill settles it. One
    row a device and budget, so its windows hold the fleet's table only.
    """
    full = F.lit(float(cap)) * F.col("weight")
    each = weights.select("client_id", "weight", F.inline(F.array(*(F.struct(F.lit(k).alias("budget_id"), F.lit(float(v)).alias("budget")) for k, v in budgets.items()))))
    w = Window.partitionBy("budget_id")
    before = w.orderBy("weight", "client_id").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(full).over(before), F.lit(0.0))
    rest = F.count("*").over(w) - F.coalesce(F.count("*").over(before), F.lit(0))
    level = (F.col("budget") - filled) / rest
    out = each.withColumn("__c", F.when(level < full, level))
    # Without any unfilled device everyone is at the cap.
    top = F.least(F.lit(float(cap)), F.col("budget") / F.min("weight").over(w))
    c = F.coalesce(F.first("__c", ignorenulls=True).over(w.orderBy("weight", "client_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), top)
    return out.select("budget_id", "budget", "client_id", F.least(c / F.col("weight"), F.lit(float(cap))).alias("target_rate"))


def _solved(points: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """points (keys, client_id, grid_ix, target_rate, utility, utility_variance, weight, forbidden, budget): a solver a group.

    A group is one problem: clients x grid rows, whatever the data behind them.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["client_id", "grid_ix"])
        clients = rows["client_id"].unique()
        shape = (len(clients), -1)
        rates = rows["target_rate"].to_numpy().reshape(shape)[0]
        take = lambda c: rows[c].to_numpy().reshape(shape)
        choice, objective, status = fn(rates, take("utility"), take("utility_variance"), take("weight")[:, 0].astype(float), take("forbidden").astype(bool), float(rows["budget"].iat[0]))
        head = {k: rows[k].iat[0] for k in keys}
        return pd.DataFrame([{**head, "client_id": c, "grid_ix": None if choice is None else int(j), "target_rate": None if choice is None else float(rates[j]), "objective": objective, "status": status} for c, j in zip(clients, choice if choice is not None else [0] * len(clients), strict=True)])

    return points.groupBy(*keys).applyInPandas(run, schema)


SCHEMA = "client_id string, grid_ix int, target_rate double, objective double, status string"


def _greedy(rates, u, v, w, forbidden, budget):
    at = solver.solve_greedy(rates, u, w, budget, CAP)
    return at, float(np.mean([u[k][j] for k, j in enumerate(at)])), "OPTIMAL"


def _macro(rates, u, v, w, forbidden, budget):
    out = solver.solve_macro(rates, u, v, w, budget)
    return out["choice"], out["objective"], out["status"]


def _minimax(rates, u, v, w, forbidden, budget):
    out = solver.solve_minimax(rates, u, v, w, forbidden, budget)
    return out["choice"], out["objective"], out["status"]


def allocate(points: DataFrame, policy: str, keys: tuple[str, ...] = ("problem",)) -> DataFrame:
    """policy: greedy, macro or minimax. Infeasible problems come back EXCLUDED, with null rates."""
    types = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + SCHEMA
    return _solved(points, list(keys), {"greedy": _greedy, "macro": _macro, "minimax": _minimax}[policy], schema)


def problem_points(util: DataFrame, weights: DataFrame, budget: float, forbidden: DataFrame | None = None, problem: str = "p") -> DataFrame:
    """A solver's table: utilities with weights, forbidden marks and the budget."""
    out = util.join(F.broadcast(weights), "client_id").withColumns({"budget": F.lit(float(budget)), "problem": F.lit(problem)})
    if forbidden is None:
        return out.withColumn("forbidden", F.lit(False))
    return out.join(forbidden.select("client_id", "grid_ix", "forbidden"), ["client_id", "grid_ix"])


def allocation_problem(scores: DataFrame, weights: DataFrame, budget: float, grid: tuple[float, ...] | None = None, min_client: int = 100, min_subtypes: int = 2, min_rows: int = 50, factor: float = 1.0, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """(points, fallback) of one budget: what a solver chooses from, and (client_id, target_rate) of clients that are not eligible.

    scores: client_id, attack_subtype, score, split. The clients of scores and weights must be the same; else reading
    either is an error. Clients that are not eligible take the budget as their rate, at most the cap, and what their
    weights leave of the budget is the problem's. forbidden marks rates that calibration rows cannot tell from 0.
    """
    from fleetward.operators import frontier
    from fleetward.operators.checks import covering
    from fleetward.operators.evaluate import CALIBRATION

    people = covering(scores.select("client_id").distinct(), weights.select("client_id", "weight"), ["client_id"], [], "problem")
    conf = frontier.confusions(scores, grid or frontier.GRID)
    able = people.join(frontier.eligibility(conf, min_client, min_subtypes, min_rows).select("client_id", "eligible"), "client_id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    rate = float(min(budget, cap))
    reserved = F.sum(F.when(~F.col("eligible"), F.col("weight") * rate).otherwise(0.0)).over(Window.partitionBy(F.lit(1)))
    able = able.withColumn("budget", F.greatest(F.lit(0.0), F.lit(float(budget)) - reserved))
    n_cal = scores.where(F.col("split").isin(*CALIBRATION)).groupBy("client_id").agg(F.count("score").alias("n_cal"))
    points = frontier.utilities(conf, min_rows).join(able.where("eligible").drop("eligible"), "client_id").join(n_cal, "client_id", "left")
    unseen = (F.col("target_rate") > TIGHT) & (F.col("target_rate") < F.lit(float(factor)) / (F.coalesce("n_cal", F.lit(0)) + 1))
    return points.withColumn("forbidden", unseen).drop("n_cal"), able.where(~F.col("eligible")).select("client_id", F.lit(rate).alias("target_rate"))


def exhaustive(util: DataFrame, weights: DataFrame, budget: float, clients: list[str]) -> DataFrame:
    """One row: the best mean utility of all combinations, by chained joins; for a handful of devices and rates."""
    out = None
    both = util.join(F.broadcast(weights), "client_id")
    for k, c in enumerate(clients):
        own = both.where(F.col("client_id") == c).select(F.col("utility").alias(f"u{k}"), (F.col("weight") * F.col("target_rate")).alias(f"c{k}"))
        out = own if out is None else out.crossJoin(own)
    n = len(clients)
    cost, total = sum(F.col(f"c{k}") for k in range(n)), sum(F.col(f"u{k}") for k in range(n))
    return out.where(cost <= budget + TIGHT).agg(F.max(total / n).alias("objective"), F.count("*").alias("feasible"))


def pooled_shared(scores: DataFrame, weights: DataFrame, budget: float) -> DataFrame:
    """One threshold for the whole fleet at one budget: (threshold, macro_recall, fleet_fpr)."""
    return pooled_thresholds(scores.withColumn("__one", F.lit(1)), weights, {"b": budget}, ["__one"]).select("threshold", "macro_recall", "fleet_fpr")


def pooled_thresholds(scores: DataFrame, weights: DataFrame, budgets: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, budget_id, budget, threshold, macro_recall, fleet_fpr): for each of keys and budget one threshold for all.

    Candidates are the distinct frontier scores and +inf. Above a candidate, each benign score weighs
    weight / (benign rows of its client) in the fleet's rate, each attack score 1 / (rows of its subtype x subtypes
    x clients) in the recall: both are running sums over one table of distinct scores. Of the feasible ones the best
    recall wins, the lowest threshold among equals.
    """
    front = scores.where(F.col("split").isin("benign_frontier", "attack_validation"))
    n = front.groupBy(*keys, "client_id", "attack_subtype").agg(F.count("*").alias("n"))
    per = n.groupBy(*keys, "client_id").agg(F.count("attack_subtype").alias("subtypes")).withColumn("clients", F.count("*").over(Window.partitionBy(*keys)))
    share = n.join(per, [*keys, "client_id"]).join(weights, "client_id").select(
        *keys, "client_id", F.coalesce("attack_subtype", F.lit("")).alias("kind"),
        F.when(F.col("attack_subtype").isNull(), F.col("weight") / F.col("n")).otherwise(0.0).alias("fpr"),
        F.when(F.col("attack_subtype").isNotNull(), 1 / (F.col("n") * F.col("subtypes") * F.col("clients"))).otherwise(0.0).alias("tpr"),
    )
    rows = front.select(*keys, "client_id", F.coalesce("attack_subtype", F.lit("")).alias("kind"), "score").join(F.broadcast(share), [*keys, "client_id", "kind"])
    at = rows.groupBy(*keys, "score").agg(F.sum("fpr").alias("f"), F.sum("tpr").alias("r"), F.max((F.col("kind") == "").cast("int")).alias("candidate"))
    above = running_sums(at, keys, "score", {"fleet_fpr": "f", "macro_recall": "r"}, descending=True)
    above = above.where(F.col("candidate") == 1).select(*keys, F.col("score").alias("threshold"), "macro_recall", "fleet_fpr")
    never = front.select(*keys).distinct().select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("macro_recall"), F.lit(0.0).alias("fleet_fpr"))
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("budget_id"), F.lit(float(v)).alias("budget")) for k, v in budgets.items())))
    ok = above.unionByName(never).select("*", each).where(F.col("fleet_fpr") <= F.col("budget") + TIGHT)
    # Sums of shares in another order differ in their last digits, which must not decide between equals.
    best = F.max(F.struct(F.round("macro_recall", 12).alias("m"), (-F.col("threshold")).alias("t"), "macro_recall", "fleet_fpr")).alias("best")
    out = ok.groupBy(*keys, "budget_id", "budget").agg(best)
    return out.select(*keys, "budget_id", "budget", (-F.col("best.t")).alias("threshold"), F.col("best.macro_recall").alias("macro_recall"), F.col("best.fleet_fpr").alias("fleet_fpr"))


#: All policies, in the order of reports.
POLICIES = ("equal_rate", "equal_alert", "greedy", "macro", "minimax", "test_oracle", "pooled_shared")


def decisions(scores: DataFrame, weights: DataFrame, budgets: dict[str, float], grid: tuple[float, ...] | None = None, min_client: int = 100, min_rows: int = 50, cap: float = CAP, factor: float = 1.0) -> DataFrame:
    """(seed, budget_id, budget, policy, client_id, target_rate, status) of every policy but pooled_shared, for all seeds and budgets.

    scores: seed, client_id, label, attack_subtype, score, split. Clients that are not eligible take the fallback
    rate under the optimised policies, and what is left of the budget goes to the others. A problem that cannot be
    solved is EXCLUDED, with null rates. Problems are tables of clients times rates. minimax may not choose rates
    above 0 that a client's calibration rows (frontier and final) cannot tell from 0: those below factor / (n + 1).
    A budget above the cap is an error.
    """
    from fleetward.operators import frontier
    from fleetward.operators.evaluate import CALIBRATION
    from fleetward.operators.splits import oracle_view
    from fleetward.staging import staged

    over = {k: v for k, v in budgets.items() if v > cap}
    if over:
        raise ValueError(f"budgets {over} are above the cap {cap} of a device")
    rates = grid or frontier.GRID
    # Tables of clients, budgets and rates: each is read by many of the plans below.
    people = staged(scores.select("seed", "client_id").distinct(), "people")
    weights = staged(weights, "weights")
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("budget_id"), F.lit(float(v)).alias("budget")) for k, v in budgets.items())))
    cells = people.select("*", each)
    named = lambda policy: ("seed", "budget_id", "budget", F.lit(policy).alias("policy"), "client_id", "target_rate", F.lit("OPTIMAL").alias("status"))
    out = cells.withColumn("target_rate", F.col("budget")).select(*named("equal_rate"))
    alert = equal_alerts(weights, budgets, cap).select("budget_id", "client_id", "target_rate")
    out = out.unionByName(cells.join(alert, ["budget_id", "client_id"]).select(*named("equal_alert")))
    n_cal = staged(scores.where(F.col("split").isin(*CALIBRATION)).groupBy("seed", "client_id").agg(F.count("score").alias("n_cal")), "calibration")
    one = F.concat(F.col("seed").cast("string"), F.lit("/"), F.col("client_id"))
    for view, names in ((scores, ("greedy", "macro", "minimax")), (oracle_view(scores), ("test_oracle",))):
        conf = frontier.confusions(view.withColumn("client_id", one), rates)
        parted = lambda df: df.withColumns({"seed": F.split("client_id", "/", 2)[0].cast(dict(scores.dtypes)["seed"]), "client_id": F.split("client_id", "/", 2)[1]})
        conf = staged(conf, "confusions")
        able = parted(frontier.eligibility(conf, min_client, min_rows=min_rows)).select("seed", "client_id", "eligible")
        util = parted(frontier.utilities(conf, min_rows))
        both = staged(cells.join(able, ["seed", "client_id"], "left").join(F.broadcast(weights), "client_id").withColumn("eligible", F.coalesce("eligible", F.lit(False))), "eligible")
        fallback = F.least(F.col("budget"), F.lit(cap))
        left = both.groupBy("seed", "budget_id").agg(F.sum(F.when(~F.col("eligible"), F.col("weight") * fallback).otherwise(0.0)).alias("reserved"))
        points = util.join(both.where("eligible").drop("eligible"), ["seed", "client_id"]).join(left, ["seed", "budget_id"])
        points = points.withColumn("budget", F.greatest(F.lit(0.0), F.col("budget") - F.col("reserved")))
        unseen = (F.col("target_rate") > 0) & (F.col("target_rate") < F.lit(float(factor)) / (F.coalesce("n_cal", F.lit(0)) + 1))
        for name in names:
            # The solver of the other policies has no such rule.
            asked = points.join(n_cal, ["seed", "client_id"], "left").withColumn("forbidden", unseen).drop("n_cal") if name == "minimax" else points.withColumn("forbidden", F.lit(False))
            solved = allocate(asked, "macro" if name == "test_oracle" else name, ("seed", "budget_id")).select("seed", "budget_id", "client_id", "target_rate", "status")
            got = both.join(solved.withColumnRenamed("target_rate", "own"), ["seed", "budget_id", "client_id"], "left")
            out = out.unionByName(got.select("seed", "budget_id", "budget", F.lit(name).alias("policy"), "client_id", F.coalesce(F.when(~F.col("eligible"), fallback), "own").alias("target_rate"), F.when(F.col("eligible"), F.coalesce("status", F.lit("EXCLUDED"))).otherwise("FALLBACK").alias("status")))
    return out


def run_all(scores: DataFrame, weights: DataFrame, budgets: dict[str, float], grid: tuple[float, ...] | None = None, min_client: int = 100, min_rows: int = 50, cap: float = CAP, factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """results and evaluations of run_tables()."""
    out = run_tables(scores, weights, budgets, grid, min_client, min_rows, cap, factor)
    return out["results"], out["evaluations"]


def run_tables(scores: DataFrame, weights: DataFrame, budgets: dict[str, float], grid: tuple[float, ...] | None = None, min_client: int = 100, min_rows: int = 50, cap: float = CAP, factor: float = 1.0) -> dict[str, DataFrame]:
    """results, evaluations and allocations of all policies at all seeds and budgets.

    allocations: decisions(). results: evaluate() rows by seed, budget and policy. evaluations: fleet() rows with status, COMPLETED, or EXCLUDED
    (and nulls) where a policy's problem has no solution. The pooled threshold is absolute: it is calibrated on no
    rows, and its n_cal is 0.
    """
    from fleetward.operators import evaluate
    from fleetward.staging import staged

    scores, weights = staged(scores.select("seed", "client_id", "label", "attack_subtype", "score", "split"), "scores"), staged(weights, "weights")
    asked = staged(decisions(scores, weights, budgets, grid, min_client, min_rows, cap, factor), "decisions")
    by, keys = ("budget_id", "budget", "policy"), ("seed", "client_id")
    whole = asked.groupBy("seed", *by).agg(F.count_if(F.col("target_rate").isNull()).alias("__open"))
    ready = asked.join(whole.where(F.col("__open") == 0).select("seed", "budget_id", "policy"), ["seed", "budget_id", "policy"]).drop("status")
    cut = evaluate.final_thresholds(scores, ready, keys).select("seed", "client_id", *by, "target_rate", "n_cal", "threshold")
    pooled = pooled_thresholds(scores, weights, budgets, ["seed"]).select("seed", "budget_id", "budget", F.lit("pooled_shared").alias("policy"), "threshold")
    pooled = pooled.join(scores.select(*keys).distinct(), "seed").withColumns({"target_rate": F.lit(None).cast("double"), "n_cal": F.lit(0).cast("long")})
    results = evaluate.evaluate(scores, staged(cut.unionByName(pooled.select(*cut.columns)), "thresholds"), keys, by)
    results = staged(results, "results")
    done = evaluate.fleet(evaluate.per_client(results, ("seed", *by)), weights, None, ("seed", *by)).withColumn("status", F.lit("COMPLETED"))
    shut = whole.where(F.col("__open") > 0).select("seed", *by, F.lit("EXCLUDED").alias("status"))
    return {"results": results, "evaluations": done.unionByName(shut, allowMissingColumns=True), "allocations": asked}
