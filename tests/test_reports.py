"""Report tables against plain sums, and intervals by bins against all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetward.operators import events, infer, reports

BUDGETS = {"b10": 0.02, "b2": 0.005}


def evaluations(spark):
    rng = np.random.default_rng(0)
    rows = [(s, b, p, *rng.random(5).tolist(), "COMPLETED") for s in range(4) for b in BUDGETS for p in ("macro", "equal_rate", "pooled_shared")]
    rows += [(9, "b2", "macro", None, None, None, None, None, "EXCLUDED")]
    rows = [(*r[:6], None, *r[7:]) if r[2] == "pooled_shared" else r for r in rows]
    return rows, spark.createDataFrame(rows, "seed long, budget_id string, policy string, macro_recall double, worst_recall double, fleet_fpr double, usage double, auroc double, status string".replace("fleet_fpr double, usage", "fleet_fpr double, usage"))


def test_tables(spark):
    rows, evals = evaluations(spark)
    summary = reports.summaries(evals)
    got = {(r["level"], r["budget_id"], r["policy"]): r for r in summary.collect()}
    assert len(got) == 6 + 3 + 2 + 1
    for (level, b, p), r in got.items():
        own = [x for x in rows if x[-1] == "COMPLETED" and b in (None, x[1]) and p in (None, x[2])]
        assert (level, r["n"]) == ("cell" if b and p else "budget" if b else "policy" if p else "all", len(own))
        for k, name in enumerate(("macro_recall", "worst_recall", "fleet_fpr", "usage", "auroc")):
            values = [x[3 + k] for x in own if x[3 + k] is not None]
            assert (r[name] is None) == (not values) and (not values or abs(r[name] - np.mean(values)) < 1e-12)
        assert r["gini"] is None
    order = ("equal_rate", "macro", "pooled_shared")
    table = reports.budget_policy_table(summary, BUDGETS, reports.PRIMARY_COLUMNS, order).collect()
    assert [(r["budget"], r["policy"]) for r in table] == [(b, p) for b in ("0.0050", "0.0200") for p in order]
    assert table[0]["macro recall"] == f"{got['cell', 'b2', 'equal_rate']['macro_recall']:.4f}"
    second = reports.budget_policy_table(summary, BUDGETS, reports.SECONDARY_COLUMNS, order)
    assert second.columns == ["budget", "policy", *reports.SECONDARY_COLUMNS] and second.first()["false-alert gini"] == reports.ABSENT
    external = reports.external_table(summary, BUDGETS).collect()
    assert [r["budget"] for r in external] == ["0.0050", "0.0200"] and external[1]["federation fpr"] == f"{got['cell', 'b10', 'macro']['fleet_fpr']:.4f}"
    assert [tuple(r) for r in reports.rotation_table(spark, {"r1": ("f1", ("f2", "f3"))}).collect()] == [("r1", "f1", "f2, f3")]


def test_contrasts_and_report(spark, tmp_path):
    _, evals = evaluations(spark)
    got = {r["budget_id"]: r for r in reports.contrast_summary(evals, [("macro", "equal_rate", "macro_recall")]).collect()}
    for b in BUDGETS:
        diffs = infer.paired_differences(evals, "macro", "equal_rate", "macro_recall").where((F.col("budget_id") == b) & F.col("diff").isNotNull())
        own = [r["diff"] for r in diffs.collect()]
        assert got[b]["included"] == 4 and abs(got[b]["mean"] - np.mean(own)) < 1e-12 and abs(got[b]["median"] - np.median(own)) < 1e-12
        assert got[b]["low"] <= got[b]["mean"] <= got[b]["high"] and got[b]["p"] <= got[b]["adjusted"]
    tables = reports.report(evals, BUDGETS, ("equal_rate", "macro"), [("macro", "equal_rate", "worst_recall")], external=evals)
    assert set(tables) == {"budget_policy_summary", "secondary_metrics", "statistics", "totals", "external_replication"} and tables["totals"].count() == 6
    allocations = spark.createDataFrame([(0, "b2", "macro", "FALLBACK"), (0, "b2", "macro", "OPTIMAL")], "seed long, budget_id string, policy string, status string")
    own = reports.with_fallback(evals, allocations)
    assert reports.write_summary(own, str(tmp_path / "summary"))
    back = spark.read.option("header", True).csv(str(tmp_path / "summary"))
    assert back.columns == ["seed", "budget", "policy", "macro_recall", "worst_client_recall", "federation_fpr", "budget_usage", "fallback_rate"] and back.count() == 24
    assert [r["fallback_rate"] for r in back.where("seed = 0 and budget = 'b2' and policy = 'macro'").collect()] == ["0.5"]
    assert not reports.write_summary(evals.limit(0), str(tmp_path / "none")) and not os.path.exists(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no report table"):
        reports.write_summary(evals, str(tmp_path / "much"), most_rows=3)


@pytest.mark.parametrize("width", [None, 0.5, 3.0])
def test_intervals_by_bins(spark, width):
    """Short, long, empty, overlapping and repeated intervals; points at their ends."""
    rng = np.random.default_rng(1)
    spans = [("ab"[k % 2], float(s), float(s) + float(rng.choice([0, 0.3, 1, 8, 500])), k % 3) for k, s in enumerate(rng.integers(-40, 400, 80))] + [("a", 5.0, 4.0, 0), ("a", None, 9.0, 0), ("a", 1.0, 1024.0, 7), ("a", 1.0, 1024.0, 7), ("z", 0.0, 1.0, 1)]
    times = [("ab"[k % 2], float(t), k) for k, t in enumerate(rng.integers(-50, 900, 150) / 2)] + [("a", None, 999), (None, 3.0, 998)]
    intervals = spark.createDataFrame(spans, "client_id string, start double, end double, kind int")
    points = spark.createDataFrame(times, "client_id string, t double, point int")
    pairs = [(*s, t, p) for s in spans for c, t, p in times if c == s[0] and None not in (s[1], t) and s[1] <= t <= s[2]]
    assert sorted(map(tuple, events.in_intervals(points, intervals, width=width).collect())) == sorted(pairs)
    hit = {s[:4] for s in pairs}
    text = lambda rows: sorted(map(str, rows))
    assert text(map(tuple, events.in_intervals(points, intervals, how="left_semi", width=width).collect())) == text(s for s in spans if s in hit)
    assert text(map(tuple, events.in_intervals(points, intervals, how="left_anti", width=width).collect())) == text(s for s in spans if s not in hit)
    plan = events.in_intervals(points, intervals, width=width)._jdf.queryExecution().executedPlan().toString()
    assert "Nested" not in plan and "__bin" in plan.split("Join", 1)[1].split("\\n", 1)[0]


def test_figure_data(spark):
    rows, evals = evaluations(spark)
    results = spark.createDataFrame([(s, b, "macro", c, k, 0.01, 1.0 + s, 0.02, 0.5 + s / 10) for s in (0, 1) for b in BUDGETS for c in "xy" for k in "pq"], "seed long, budget_id string, policy string, client_id string, attack_subtype string, target_rate double, threshold double, fpr double, recall double")
    curves = spark.createDataFrame([("x", 0.01, 0.5, 0.1)], "client_id string, target_rate double, utility double, utility_variance double")
    drawn = spark.createDataFrame([("x", r, float(r)) for r in range(9)], "client_id string, replicate int, target_rate double")
    spread = spark.createDataFrame([(0, 0.2), (0, 0.4), (7, 0.1)], "seed long, aggregate double")
    got = reports.figure_data(evals, results, curves, drawn, spread, BUDGETS)
    curve = {(r["metric"], r["policy"], r["budget"]): r["value"] for r in got["policy_curves"].collect()}
    assert len(curve) == 2 * 6 + 4 and ("usage", "pooled_shared", 0.02) not in curve
    assert abs(curve["macro_recall", "macro", 0.005] - np.mean([r[3] for r in rows if r[1:3] == ("b2", "macro") and r[-1] == "COMPLETED"])) < 1e-12
    assert {(r["client_id"], r["threshold"]) for r in got["operating_points"].collect()} == {("x", 1.5), ("y", 1.5)}
    assert [tuple(r) for r in got["stability"].collect()] == [("x", 9, 0.0, 2.0, 4.0, 6.0, 8.0)]
    assert [tuple(r) for r in got["utility_curves"].collect()] == [("x", 0.01, 0.5)]
    gain = got["gain_heterogeneity"].collect()
    assert [r["seed"] for r in gain] == [0] and abs(gain[0]["heterogeneity"] - 0.3) < 1e-12
