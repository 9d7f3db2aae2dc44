"""Problems and evaluations of exactly the fleet's clients, and event runs behind their gate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetward.operators import evaluate, events, frontier, policies
from fleetward.sources import commits, timed


def scores(spark, clients=("a", "b", "z")):
    rng = np.random.default_rng(4)
    rows = []
    for c in clients:
        rows += [(c, "benign", None, float(x), s) for s, n in (("benign_frontier", 150), ("benign_final_cal", 49)) for x in rng.normal(size=n)]
        rows += [(c, "attack", k, float(x), "attack_validation") for k in "pq" for x in rng.normal(2, 1, 5 if c == "z" else 60)]
    return spark.createDataFrame(rows, "client_id string, label string, attack_subtype string, score double, split string")


def test_problem(spark):
    df = scores(spark)
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("z", 0.2)], "client_id string, weight double")
    points, fallback = policies.allocation_problem(df, weights, 0.02, (0.0, 0.004, 0.01, 0.05))
    assert [tuple(r) for r in fallback.collect()] == [("z", 0.02)]
    got = {(r["client_id"], r["grid_ix"]): r for r in points.collect()}
    assert set(got) == {(c, g) for c in "ab" for g in range(4)} and all(abs(r["budget"] - 0.016) < 1e-12 for r in got.values())
    assert {k for k, r in got.items() if r["forbidden"]} == {("a", 1), ("b", 1)}  # 0.004 < 1 / 200
    util = {(r["client_id"], r["grid_ix"]): r["utility"] for r in frontier.utilities(frontier.confusions(df, (0.0, 0.004, 0.01, 0.05))).collect()}
    assert all(abs(r["utility"] - util[k]) < 1e-12 for k, r in got.items())
    rates = {r["client_id"]: r["target_rate"] for r in policies.allocate(points.withColumn("problem", F.lit("p")), "minimax").collect()}
    assert set(rates) == {"a", "b"} and 0.5 * rates["a"] + 0.3 * rates["b"] <= 0.016 + 1e-12 and 0.004 not in rates.values()
    for other, what in (([("a", 0.5), ("b", 0.5)], "no z in the reference"), ([("a", 0.4), ("b", 0.3), ("z", 0.2), ("y", 0.1)], "not all of the reference")):
        with pytest.raises(Exception, match=what):
            policies.allocation_problem(df, spark.createDataFrame(other, "client_id string, weight double"), 0.02)[0].collect()


def test_evaluations_of_the_whole_fleet(spark):
    rows = [(b, c, 0.5, 0.01, 1, 99, 10, 10, 0.5, 0.7) for b in ("b1", "b2") for c in ("a", "b")]
    schema = "budget_id string, client_id string, macro_recall double, fpr double, fp long, tn long, tp long, fn long, f1 double, balanced_accuracy double"
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "client_id string, weight double")
    run = lambda x, w=weights: evaluate.fleet(spark.createDataFrame(x, schema), w, 0.02, ("budget_id",), complete=True).collect()
    assert {r["budget_id"]: r["fleet_fpr"] for r in run(rows)} == {"b1": 0.01, "b2": 0.01}
    with pytest.raises(Exception, match="not all of the reference in b2"):
        run(rows[:3])
    with pytest.raises(Exception, match="no b in the reference"):
        run(rows, weights.where("client_id = 'a'"))


def test_event_run(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(c, "benign" if k % 9 else "attack", float(60 * k), float(rng.exponential()) + (3.0 if k % 9 == 0 else 0)) for c in ("a", "b") for k in range(400)]
    obs = spark.createDataFrame(rows, "client_id string, label string, t double, score double")
    status = lambda x: spark.createDataFrame([(x,)], "status string")
    settings = {"budgets": {"b1": 0.05, "b2": 0.2}, "steps": {"dilation": (600.0, 1200.0), "merge": (3000.0,), "least": (60.0,), "cooldown": (6000.0,)}, "per_hour": (0.5,)}
    path = str(tmp_path / "events")
    assert timed.event_run(spark, path, {0: obs}, status("FAIL"), **settings) == "GATED"
    assert timed.event_run(spark, path, {0: obs.limit(0)}, status("PASS"), **settings) == "EMPTY" and commits.current(spark, path) == {}
    assert timed.event_run(spark, path, {0: obs, 3: obs.where("client_id = 'a'"), 4: obs.limit(0)}, status("PASS"), **settings) == "WRITTEN"
    got = commits.current(spark, path)
    assert set(got) == {"metrics", "robustness", "gini", "budgets"}
    assert {(r["seed"], r["client_id"]) for r in got["metrics"].collect()} == {(0, "a"), (0, "b"), (3, "a")}
    assert got["robustness"].select("dilation").distinct().count() == 2 and {r["budget_id"] for r in got["gini"].collect()} == {"b1", "b2"}
    one = {(r["client_id"], r["budget_id"]): r["benign_events"] for r in got["metrics"].where("seed = 0").collect()}
    cut = {}
    for c in "ab":
        benign = sorted(s for d, k, _, s in rows if (d, k) == (c, "benign"))
        for b, rate in settings["budgets"].items():
            cut[c, b] = benign[int(np.ceil((len(benign) + 1) * (1 - rate))) - 1]
    for (c, b), x in cut.items():
        alerts = spark.createDataFrame([(c, t) for d, k, t, s in rows if (d, k) == (c, "benign") and s > x], "client_id string, t double")
        assert one[c, b] == events.eventize(alerts, ["client_id"]).count()
