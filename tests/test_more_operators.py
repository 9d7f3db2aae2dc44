"""Cells at quantiles, closed forms, steps across slices, lookups, contrasts and the run of all policies."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetward.operators import calibrate, checks, evaluate, events, frontier, infer, lookups, policies, ranking, scoring
from fleetward.plans import solver


@pytest.mark.parametrize("kind", ["heavy", "outlier", "odd", "one"])
def test_cells_follow_the_values(spark, kind):
    """No cell holds much more than its share, whatever the spread; infinities, NaN and null have a place."""
    rng = np.random.default_rng(0)
    values = {"heavy": np.exp(3 * rng.normal(size=4000)), "outlier": np.r_[rng.random(3999), 1e12], "odd": np.r_[rng.random(3000), [math.inf] * 5, [-math.inf] * 5, [math.nan] * 5], "one": np.full(50, 3.0)}[kind]
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("k", None)], "k string, v double")
    cells = ranking._celled(df, ["k"], "v", 64).groupBy("__cell").count().collect()
    if kind != "one":
        assert max(r["count"] for r in cells) < 4 * len(values) / 64
    got = sorted((r["position"], r["v"]) for r in ranking.positions(df, ["k"], "v", cells=64).collect())
    assert [p for p, _ in got] == list(range(1, len(values) + 2)) and got[0][1] is None
    want = sorted((math.inf, 1) if math.isnan(v) else (v, 0) for v in values.tolist())
    assert [(math.inf, 1) if math.isnan(v) else (v, 0) for _, v in got[1:]] == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 100])
def test_count_below(spark, n):
    have = [float(2 * k) for k in range(n)]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 2.0, 7.5, 198.0, 999.0, math.inf)], "x double")
    array = F.array(*map(F.lit, have)) if have else F.array().cast("array<double>")
    assert all(r["n"] == sum(h < r["x"] for h in have) for r in df.select("x", ranking.count_below(array, F.col("x"), max(n, 1)).alias("n")).collect())


def test_thresholds_of_many_equal_scores(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.integers(0, 4, 1000)] + [("b", 1.0)] * 7
    df = spark.createDataFrame(rows, "client_id string, score double")
    rates = [0.0, 1e-4, 0.002, 0.05, 0.2, 0.5, 0.75, 0.999, 1.0]
    ask = spark.createDataFrame([(c, r) for c in "abz" for r in rates], "client_id string, target_rate double")
    for r in calibrate.thresholds(df, ask).collect():
        own = sorted(s for c, s in rows if c == r["client_id"])
        k = math.ceil((len(own) + 1) * (1 - r["target_rate"]))
        assert r["threshold"] == (math.inf if r["target_rate"] == 0 or not own or k > len(own) else -math.inf if k < 1 else own[k - 1])


@pytest.mark.parametrize("n", [0, 1, 5, 31, 32, 33, 1000, 10**6])
def test_harmonic(spark, n):
    got = spark.range(1).select(evaluate.harmonic(F.lit(float(n))).alias("h")).first()["h"]
    assert abs(got - sum(1 / k for k in range(1, n + 1))) < 1e-11


def test_areas_of_one_score(spark):
    """A million attack rows of one score cost no array of a million."""
    df = spark.range(1_200_000).select(F.lit("k").alias("client_id"), F.when(F.col("id") < 200_000, "benign").otherwise("attack").alias("label"), F.lit(1.0).alias("score"))
    i = np.arange(1, 10**6 + 1)
    precision = np.r_[0.0, i / (200_000 + i)]
    assert abs(evaluate.auprc(df, ["client_id"]).first()["auprc"] - np.mean((precision[1:] + precision[:-1]) / 2)) < 1e-9
    assert evaluate.auroc(df, ["client_id"]).first()["auroc"] == 0.5


def test_binomial_bound_by_sums():
    for tp, fn in ((1, 0), (1, 9), (7, 3), (40, 2), (150, 350), (3000, 1)):
        p = float(scoring.binomial_lower_bound(np.array([tp]), np.array([fn]), 0.95)[0])
        n = tp + fn
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(tp, n + 1))
        assert abs(tail - 0.05) < 1e-7
    big = float(scoring.binomial_lower_bound(np.array([9 * 10**8]), np.array([10**8]), 0.95)[0])
    assert 0.89998 < big < 0.9


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_steps_across_slices(spark, slices):
    rng = np.random.default_rng(2)
    rows = [(c, int(o), float(rng.integers(0, 50))) for c in ("a", "b", None) for o in rng.permutation(200)[:120]]
    got = events.steps_back(spark.createDataFrame(rows, "k string, o long, t double"), ["k"], "o", slices).collect()
    for c in ("a", "b", None):
        own = sorted((o, t) for k, o, t in rows if k == c)
        want = [None, *(b - a for (_, a), (_, b) in zip(own, own[1:], strict=False))]
        assert [r["d"] for r in sorted((r for r in got if r["k"] == c), key=lambda r: r["o"])] == want


def test_digest_counts_repeats(spark):
    of = lambda rows: checks.digest(spark.createDataFrame(rows, "k string, a string, b long"), ["k"], ["a", "b"]).first()["digest"]
    assert of([("k", "a", 1), ("k", "a", 1)]) != of([("k", "b", 2), ("k", "b", 2)])
    assert of([("k", "a", 1), ("k", "b", 2)]) == of([("k", "b", 2), ("k", "a", 1)])
    assert of([("k", "", 1)]) != of([("k", None, 1)]) and of([("k", "a|1:1", None)]) != of([("k", "a", 1)])


def test_ladder(spark):
    state = lambda *cells: checks.ladder(spark.createDataFrame([(c,) for c in cells], "state string")).first()["state"]
    assert state("MISSING", "MISSING") == "NOT_STARTED" and state("MISSING", "MALFORMED", "VALID") == "EXECUTION_INCOMPLETE" and state("MALFORMED", "VALID") == "FAILED"
    assert state("INCOMPLETE", "STALE") == "EVIDENCE_INCOMPLETE" and state("STALE", "VALID") == "STALE" and state("VALID") == "PASSED"


def test_lookups(spark):
    rows = spark.createDataFrame([("f", 0, "a", 1.0), ("f", 1, " ", 2.0), ("f", 2, "a", None), ("g", 0, "b", 4.0)], "source_file string, source_row long, client_id string, t double").withColumns({"label": F.lit("attack"), "attack_subtype": F.lit("x")})
    scores = spark.createDataFrame([("f", 0, 0.5, "benign"), ("f", 1, 0.6, "benign"), ("f", 2, 0.7, "benign"), ("f", 9, 0.8, "benign")], "source_file string, source_row long, score double, label string")
    assert [(r["client_id"], r["score"], r["label"]) for r in lookups.timed_scores(rows, scores).collect()] == [("a", 0.5, "attack")]
    with pytest.raises(ValueError, match="2 rows have the key"):
        lookups.timed_scores(rows, scores.unionByName(scores.limit(1)))
    people = spark.createDataFrame([("a",), ("b",)], "client_id string")
    rate = lambda *x: spark.createDataFrame(list(x), "client_id string, target_rate double")
    got = lookups.merge_decisions(people, rate(("a", 0.1)), rate(("a", 0.2), ("b", 0.3)))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0.1, True), ("b", 0.3, False)]
    with pytest.raises(Exception, match="no decision for client b"):
        lookups.merge_decisions(people, rate(("a", 0.1)), rate(("a", 0.2))).collect()
    gains = spark.createDataFrame([(1, 0.5), (2, 0.25)], "seed long, gain double")
    spread = spark.createDataFrame([(2, 1.0), (2, 3.0), (3, 9.0)], "seed long, aggregate double")
    assert [tuple(r) for r in lookups.gain_and_heterogeneity(gains, spread).collect()] == [(2, 0.25, 2.0)]
    spans = spark.createDataFrame([("a", 0.0, 5.0), ("a", 6.0, 7.0), ("b", 0.0, 9.0)], "client_id string, start double, end double")
    alerts = spark.createDataFrame([("a", 5.0), ("a", 7.5)], "client_id string, t double")
    assert [tuple(r) for r in events.detected_intervals(spans, alerts).collect()] == [("a", 0.0, 5.0)]


def test_areas_that_differ_are_an_error(spark):
    areas = spark.createDataFrame([("a", "p", 0.5), ("a", "q", 0.5), ("b", "p", 0.25), ("b", "q", 0.5)], "client_id string, policy string, auroc double")
    assert evaluate.invariant_areas(areas.where("client_id = 'a'"), ["client_id"]).first()["spread"] == 0.0
    with pytest.raises(Exception, match="auroc differs"):
        evaluate.invariant_areas(areas, ["client_id"]).collect()


def test_contrasts_leave_unpaired_seeds_out(spark):
    rows = [(s, "b1", p, m, w) for s, p, m, w in ((0, "equal_rate", 0.5, 0.1), (0, "macro", 0.52, 0.1), (1, "equal_rate", 0.5, 0.2), (1, "macro", 0.54, 0.2), (2, "equal_rate", 0.5, 0.2), (0, "minimax", 0.4, 0.3), (1, "minimax", 0.45, 0.5))]
    evals = spark.createDataFrame(rows, "seed long, budget_id string, policy string, macro_recall double, worst_recall double")
    r = infer.contrast(evals, "macro", "equal_rate", "macro_recall").first()
    assert (r["n"], r["excluded"], round(r["mean"], 9), r["p"]) == (2, 1, 0.03, 0.5)
    got = {r["contrast"]: (round(r["mean"], 9), r["adjusted"]) for r in infer.primary(evals).collect()}
    assert got == {"macro_recall": (0.03, 0.5), "worst_recall": (0.25, 0.5)}
    assert round(infer.guardrail(evals).first()["mean"], 9) == -0.075
    with pytest.raises(ValueError, match="seed 2 has no macro"):
        infer.policy_means(evals, "macro", "macro_recall")
    w = infer.worst_fallback(spark.createDataFrame([(0.1,), (0.4,)], "fallback_share double"), 0.25).first()
    assert (w["worst"], w["warning"]) == (0.4, True)


def test_long_grid():
    grid = frontier.long_grid()
    assert len(grid) == 207 and grid[0] == 0.0 and grid[1] == 1e-4 and grid[-1] == 0.05 and {0.001, 0.0025, 0.005, 0.01, 0.02} <= set(grid)
    assert abs(grid[2] - 0.00010315608468468423) < 1e-15


def fleet_scores(spark):
    """Two seeds; three clients with attacks that are easy, hard and too few."""
    rng = np.random.default_rng(4)
    rows = []
    for seed in (0, 1):
        for c, shift, n in (("a", 3.0, 40), ("b", 1.0, 40), ("z", 2.0, 4)):
            for split, size in (("benign_frontier", 200), ("benign_final_cal", 100), ("benign_test", 150)):
                rows += [(seed, c, "benign", None, float(x), split) for x in rng.normal(size=size)]
            for sub in ("p", "q"):
                for split, size in (("attack_validation", n), ("attack_test", 30)):
                    rows += [(seed, c, "attack", sub, float(x), split) for x in rng.normal(shift, 1, size)]
    return rows, spark.createDataFrame(rows, "seed long, client_id string, label string, attack_subtype string, score double, split string").repartition(4)


def test_run_of_all_policies(spark):
    rows, df = fleet_scores(spark)
    weight = {"a": 0.5, "b": 0.3, "z": 0.2}
    weights = spark.createDataFrame(list(weight.items()), "client_id string, weight double")
    budgets, grid = {"low": 0.01, "high": 0.04}, (0.0, 0.005, 0.01, 0.02, 0.05)
    results, evals = policies.run_all(df, weights, budgets, grid, min_client=20, min_rows=10)
    got = {(r["seed"], r["budget_id"], r["policy"]): r for r in evals.collect()}
    assert set(got) == set(itertools.product((0, 1), budgets, policies.POLICIES)) and {r["status"] for r in got.values()} == {"COMPLETED"}
    rates = {(r["seed"], r["budget_id"], r["policy"], r["client_id"]): r["target_rate"] for r in results.collect()}
    pick = lambda s, c, *names: sorted(x for q, k, _, _, x, n in rows if q == s and k == c and n in names)
    for seed, (name, budget) in itertools.product((0, 1), budgets.items()):
        assert all(rates[seed, name, p, "z"] == min(budget, 0.05) for p in ("greedy", "macro", "minimax"))
        assert all(rates[seed, name, "equal_rate", c] == budget for c in weight)
        # Macro by enumeration, over what the fallback client leaves.
        left = budget - weight["z"] * budget
        utility = {}
        for c in "ab":
            front = pick(seed, c, "benign_frontier")
            for j, a in enumerate(grid):
                k = math.ceil((len(front) + 1) * (1 - a))
                cut = math.inf if a == 0 or k > len(front) else front[k - 1]
                utility[c, j] = np.mean([np.mean([x > cut for q, d, _, t, x, n in rows if (q, d, t, n) == (seed, c, sub, "attack_validation")]) for sub in "pq"])
        best = max((np.mean([utility["a", i], utility["b", j]]) for i, j in itertools.product(range(5), repeat=2) if weight["a"] * grid[i] + weight["b"] * grid[j] <= left + 1e-12))
        own = [utility[c, grid.index(rates[seed, name, "macro", c])] for c in "ab"]
        assert np.mean(own) >= best - 2e-4
        # One row's metrics, from the thresholds up.
        for policy in ("equal_rate", "macro", "minimax", "greedy", "equal_alert"):
            recall, fpr = {}, {}
            for c in weight:
                cal = pick(seed, c, "benign_frontier", "benign_final_cal")
                k = math.ceil((len(cal) + 1) * (1 - rates[seed, name, policy, c]))
                cut = math.inf if rates[seed, name, policy, c] <= 1e-12 or k > len(cal) else cal[k - 1]
                recall[c] = np.mean([np.mean([x > cut for q, d, _, t, x, n in rows if (q, d, t, n) == (seed, c, sub, "attack_test")]) for sub in "pq"])
                fpr[c] = np.mean([x > cut for x in pick(seed, c, "benign_test")])
            r = got[seed, name, policy]
            assert abs(r["macro_recall"] - np.mean(list(recall.values()))) < 1e-9 and abs(r["worst_recall"] - min(recall.values())) < 1e-9
            assert abs(r["fleet_fpr"] - sum(weight[c] * fpr[c] for c in weight)) < 1e-9
    assert solver.tail_size(2) >= 1
    cost = frontier.weighted_cost(spark.createDataFrame([("a", 0.01), ("b", 0.02)], "client_id string, target_rate double"), weights, 0.011).first()
    assert abs(cost["cost"] - 0.011) < 1e-12 and cost["feasible"]
    assert {r["client_id"] for r in frontier.subset_weights(weights, df.where("client_id = 'a'")).collect()} == {"a"}


def test_excluded_policies_stay_in_the_table(spark):
    """A grid without 0 leaves no room at a tiny budget: the optimised policies are EXCLUDED, the others are not."""
    _, df = fleet_scores(spark)
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("z", 0.2)], "client_id string, weight double")
    _, evals = policies.run_all(df.where("seed = 0"), weights, {"tiny": 0.001}, (0.02, 0.05), min_client=20, min_rows=10)
    got = {r["policy"]: (r["status"], r["macro_recall"] is None) for r in evals.collect()}
    assert got["equal_rate"] == ("COMPLETED", False) and got["macro"] == ("EXCLUDED", True) and got["pooled_shared"][0] == "COMPLETED"


def test_minimax_leaves_rates_that_calibration_cannot_tell_from_zero(spark):
    """Rates below factor / (n + 1) are open to macro and shut to minimax, whose choice is the best of those left."""
    rows, df = fleet_scores(spark)
    df = df.where("seed = 0")
    weight, grid, budget = {"a": 0.5, "b": 0.3, "z": 0.2}, (0.0, 0.006, 0.02), 0.0085
    weights = spark.createDataFrame(list(weight.items()), "client_id string, weight double")
    rates = {}
    for factor in (0.0, 3.0):
        got = policies.decisions(df, weights, {"b": budget}, grid, min_client=20, min_rows=10, factor=factor).collect()
        rates[factor] = {(r["policy"], r["client_id"]): r["target_rate"] for r in got}
    assert rates[0.0]["minimax", "a"] == rates[0.0]["minimax", "b"] == 0.006
    assert 0.006 not in (rates[3.0]["minimax", c] for c in "ab")
    assert all(rates[0.0][p, c] == rates[3.0][p, c] for p in policies.POLICIES[:4] for c in weight)
    pick = lambda c, *names: sorted(x for q, k, _, _, x, n in rows if q == 0 and k == c and n in names)
    for factor in (0.0, 3.0):
        utility = {}
        for c in "ab":
            front, n = pick(c, "benign_frontier"), len(pick(c, "benign_frontier", "benign_final_cal"))
            for a in grid:
                k = math.ceil((len(front) + 1) * (1 - a))
                cut = math.inf if a == 0 or k > len(front) else front[k - 1]
                if not 0 < a < factor / (n + 1):
                    utility[c, a] = np.mean([np.mean([x > cut for q, d, _, t, x, s in rows if (q, d, t, s) == (0, c, sub, "attack_validation")]) for sub in "pq"])
        left = budget - weight["z"] * budget
        able = [(x, y) for (c, x) in utility for (d, y) in utility if (c, d) == ("a", "b") and weight["a"] * x + weight["b"] * y <= left + 1e-12]
        best = max(min(utility["a", x], utility["b", y]) for x, y in able)
        own = rates[factor]
        assert min(utility["a", own["minimax", "a"]], utility["b", own["minimax", "b"]]) >= best - 2e-4
    with pytest.raises(ValueError, match="above the cap"):
        policies.decisions(df, weights, {"b": 0.06}, grid)


def test_equal_alerts_by_budget(spark):
    """All budgets in one plan, against a search for the level."""
    weight = {f"c{k}": w for k, w in enumerate((0.05, 0.05, 0.1, 0.3, 0.5))}
    weights = spark.createDataFrame(list(weight.items()), "client_id string, weight double")
    budgets = {"x": 0.001, "y": 0.02, "z": 0.05}
    got = {(r["budget_id"], r["client_id"]): r["target_rate"] for r in policies.equal_alerts(weights, budgets).collect()}
    for k, b in budgets.items():
        low, high = 0.0, 1.0
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(c, 0.05 * w) for w in weight.values()) <= b else (low, c)
        for name, w in weight.items():
            assert abs(got[k, name] - min(low / w, 0.05)) < 1e-9
