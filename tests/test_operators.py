import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetward.functions import text
from fleetward.operators import calibrate, evaluate, event_budget, events, frontier, infer, policies, ranking, scoring, splits
from fleetward.plans import solver


def test_positions_match_sorting(spark):
    rng = np.random.default_rng(0)
    rows = [("a" if x < 0.8 else "b", float(v)) for x, v in zip(rng.random(500), rng.normal(size=500), strict=True)] + [("c", 1.0)] * 5
    got = ranking.positions(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", cells=7).collect()
    for k in "abc":
        own = sorted((r["position"], r["v"]) for r in got if r["k"] == k)
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert [v for _, v in own] == sorted(v for q, v in rows if q == k)
        assert {r["n"] for r in got if r["k"] == k} == {len(own)}


def test_splits_use_ieee_floors(spark):
    rows = [("c", "benign", None, float(i), i) for i in range(90)] + [("c", "attack", "x", 0.0, 100 + i) for i in range(7)]
    df = splits.split_rows(spark.createDataFrame(rows, "client_id string, label string, attack_subtype string, score double, ordinal long"))
    got = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"benign_train": 45, "benign_frontier": math.floor(0.7 * 90) - 45, "benign_final_cal": 72 - math.floor(0.7 * 90), "benign_test": 18, "attack_validation": 1, "attack_test": 6}


def test_threshold_is_an_order_statistic(spark):
    scores = [("a", x / 10) for x in range(1, 11)] + [("a", x / 10) for x in range(6, 16)]
    b = spark.createDataFrame(scores, "client_id string, score double")
    ask = spark.createDataFrame([("a", 0.1), ("a", 0.0), ("a", 0.01), ("a", 1.0), ("zz", 0.5)], "client_id string, target_rate double")
    got = {(r["client_id"], r["target_rate"]): (r["n_cal"], r["threshold"]) for r in calibrate.thresholds(b, ask).collect()}
    assert got["a", 0.1] == (20, 1.4)
    assert got["a", 0.0] == (20, math.inf) and got["a", 0.01] == (20, math.inf)
    assert got["a", 1.0] == (20, -math.inf)
    assert got["zz", 0.5] == (0, math.inf)


def _areas(benign, attack):
    y = np.r_[np.zeros(len(benign)), np.ones(len(attack))]
    s = np.r_[benign, attack]
    order = np.argsort(-s, kind="stable")
    tp, fp = np.cumsum(y[order]), np.cumsum(1 - y[order])
    recall, precision = np.r_[0, tp / len(attack)], np.r_[1, tp / (tp + fp)]
    wins = sum((a > b) + 0.5 * (a == b) for a in attack for b in benign)
    return wins / len(attack) / len(benign), float(np.sum(np.diff(recall) * (precision[1:] + precision[:-1]) / 2))


@pytest.mark.parametrize("seed", range(4))
def test_areas_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    benign, attack = rng.integers(0, 6, 30).astype(float), rng.integers(2, 9, 17).astype(float)
    df = spark.createDataFrame([("k", "benign", float(x)) for x in benign] + [("k", "attack", float(x)) for x in attack], "client_id string, label string, score double")
    roc, pr = _areas(benign, attack)
    assert abs(evaluate.auroc(df, ["client_id"]).first()["auroc"] - roc) < 1e-12
    assert abs(evaluate.auprc(df, ["client_id"]).first()["auprc"] - pr) < 1e-12


def _eventize(times, d, m, least, c):
    times = sorted(times)
    blocks = []
    for t in times:
        if blocks and t - blocks[-1][1] <= d:
            blocks[-1][1] = t
        else:
            blocks.append([t, t])
    merged = []
    for b in blocks:
        if merged and b[0] - merged[-1][1] <= m:
            merged[-1][1] = b[1]
        else:
            merged.append(list(b))
    out = []
    for s, e in [b for b in merged if b[1] - b[0] >= least]:
        n = sum(s <= t <= e for t in times)
        if out and s - out[-1][1] < c:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += n
        else:
            out.append([s, e, n])
    return [tuple(x) for x in out]


def test_eventize_matches_stepwise(spark):
    rng = np.random.default_rng(3)
    cases = [[], [10.0], [10, 10.5, 11, 11.2, 12], [0, 0.5, 4.5, 5], [0, 0.5, 1, 5, 5.5, 6], [0, 2, 7, 9, 19, 21]] + [np.round(rng.uniform(0, 200, rng.integers(1, 60)), 1).tolist() for _ in range(15)]
    rows = [(str(k), float(t)) for k, c in enumerate(cases) for t in c]
    got = events.eventize(spark.createDataFrame(rows, "client_id string, t double"), ["client_id"], 2.0, 5.0, 2.0, 10.0).collect()
    for k, c in enumerate(cases):
        own = sorted((r["start"], r["end"], r["alarms"]) for r in got if r["client_id"] == str(k))
        assert own == _eventize([float(t) for t in c], 2, 5, 2, 10)
        rule = event_budget.Rule(5, 2, 10)
        assert event_budget.events_of(event_budget.summary(np.sort(np.array(c, dtype=float)), rule), rule) == len(own)


def test_event_budget_is_the_bisection(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(t), float(s), "benign") for t, s in zip(np.sort(rng.uniform(0, 7200, 300)), rng.random(300), strict=True)] + [("b", 0.0, 1.0, "benign"), ("b", 50.0, 1.0, "benign")]
    got = {r["client_id"]: r["threshold"] for r in event_budget.thresholds(spark.createDataFrame(rows, "client_id string, t double, score double, label string"), 1.0, (2.0, 30.0, 2.0, 60.0)).collect()}
    assert got["b"] == 1.0 and 0 < got["a"] < 1


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_solver_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    k, c = int(rng.integers(2, 5)), int(rng.integers(2, 5))
    rates = np.r_[0.0, np.sort(rng.random(c - 1)) * 0.05]
    u = np.sort(rng.random((k, c)), axis=1)
    v, w = rng.random((k, c)) * 1e-3, rng.dirichlet(np.ones(k))
    budget = float(rng.random() * 0.03)
    feasible = [x for x in itertools.product(range(c), repeat=k) if sum(w[i] * rates[j] for i, j in enumerate(x)) <= budget + 1e-12]
    value = lambda x: [u[i][j] for i, j in enumerate(x)]
    best = max(np.mean(value(x)) for x in feasible)
    out = solver.solve_macro(rates, u, v, w, budget)
    assert abs(out["objective"] - best) < 1e-9
    assert tuple(out["choice"]) in set(feasible) and np.mean(value(out["choice"])) >= best - 2e-4
    worst = max(solver.worst_sum(np.array(value(x)), solver.tail_size(k)) for x in feasible)
    out = solver.solve_minimax(rates, u, v, w, np.zeros((k, c), dtype=bool), budget)
    assert abs(out["objective"] - worst) < 1e-9
    assert tuple(out["choice"]) in set(feasible)
    assert solver.worst_sum(np.array(value(out["choice"])), solver.tail_size(k)) >= worst - solver.tail_size(k) * 1e-4 - 1e-9
    at = solver.solve_greedy(rates, u, w, budget, 0.05)
    assert tuple(at) in set(feasible)


def test_equal_alert_equals_bisection(spark):
    w = {"a": 0.6, "b": 0.3, "c": 0.08, "d": 0.02}
    got = {r["client_id"]: r["target_rate"] for r in policies.equal_alert(spark.createDataFrame(list(w.items()), "client_id string, weight double"), 0.02, 0.05).collect()}
    lo, hi = 0.0, min(0.05, 0.02 / 0.02)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid, 0.05 * x) for x in w.values()) <= 0.02 + 1e-12 else (lo, mid)
    assert all(abs(got[k] - min(lo / x, 0.05)) < 1e-8 for k, x in w.items())


def test_sign_flip_and_holm(spark):
    d = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 1.0), ("y", 0, 2.0), ("y", 1, 0.0), ("z", 0, 1.0), ("z", 1, None)], "budget_id string, seed long, diff double")
    got = {r["budget_id"]: (r["n"], r["p"]) for r in infer.sign_flip(d).collect()}
    assert got == {"x": (2, 0.5), "y": (2, 1.0), "z": (1, 1.0)}
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "budget_id string, p double")
    got = {r["budget_id"]: (round(r["adjusted"], 9), r["rejected"]) for r in infer.holm(p).collect()}
    assert got == {"a": (0.03, True), "b": (0.06, False), "c": (0.06, False)}


def test_weights(spark):
    w = frontier.count_weights(spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "client_id string, n long"))
    for g in (0.0, 0.5, 1.0, 1.5):
        got = {r["client_id"]: r["weight"] for r in frontier.gamma_weights(w, g).collect()}
        total = 6**g + 3**g + 1
        assert all(abs(got[k] - n**g / total) < 1e-12 for k, n in (("a", 6), ("b", 3), ("c", 1)))


def test_binomial_bound():
    # With no failure the bound is (1 - confidence)^(1/n).
    got = scoring.binomial_lower_bound(np.array([10, 0, 5]), np.array([0, 4, 5]), 0.95)
    assert abs(got[0] - 0.05**0.1) < 1e-9 and got[1] == 0 and 0.2 < got[2] < 0.25


def test_ecdf_and_columns(spark):
    pool = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0)], "k string, v double")
    q = spark.createDataFrame([("a", 0.5), ("a", 2.0), ("a", 9.0)], "k string, v double")
    assert {r["v"]: r["pct"] for r in scoring.ecdf(pool, q, ["k"], "v").collect()} == {0.5: 0.0, 2.0: 0.75, 9.0: 1.0}
    feat = spark.createDataFrame([("a", 0, [1.0, 3.0]), ("a", 1, [3.0, 3.0])], "client_id string, row long, x array<double>")
    z = {r["row"]: r["z"] for r in scoring.standardise(feat, scoring.column_statistics(feat)).collect()}
    assert z == {0: [-1.0, 0.0], 1: [1.0, 0.0]}


def test_training_lowers_the_error(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6))
    feat = spark.createDataFrame([("ab"[k % 2], k, row.tolist()) for k, row in enumerate(x)], "client_id string, row long, z array<double>")
    error = lambda net: float(np.mean((scoring.forward(net, x)[-1] - x) ** 2))
    start = scoring.layers([6, 8, 2], 1)
    net = scoring.federated_training(feat, [6, 8, 2], rounds=3, epochs=5, seed=1)
    assert error(net) < error(start)
    again = scoring.federated_training(feat, [6, 8, 2], rounds=3, epochs=5, seed=1)
    assert all(np.allclose(a[0], b[0]) for a, b in zip(net, again, strict=True))
    assert scoring.reconstruction_scores(feat, net).count() == 200


def test_text_functions(spark):
    df = spark.createDataFrame([("\tHarman Kardon (Ampak Technology) ", "DoS & Scan", "Jan 01, 2020 00:00:01.123456789 GMT", "1e3")], "a string, b string, c string, d string")
    row = df.select(text.device_name(F.col("a")), text.label_subtype(F.col("b")), text.epoch_seconds(text.capture_time(F.col("c"))), text.number(F.col("d"))).first()
    assert row[0] == "harman kardon _ampak technology_" and row[1] == "dos---scan" and row[3] == 1000.0
    assert abs(row[2] - 1577836801.123456) < 1e-6
    bad = spark.createDataFrame([("x d", "not a time", "1d"), ("Jan  3, 2020 05:00:00", "Jan  3, 2020 05:00:00", "")], "a string, c string, d string")
    got = bad.select(text.capture_time(F.col("c")).isNull().alias("t"), text.number(F.col("d")).isNull().alias("n")).collect()
    assert [(r["t"], r["n"]) for r in got] == [(True, True), (False, True)]
    macs = spark.createDataFrame([("ff:ff:ff:ff:ff:ff",), ("33:33:00:00:00:01",), ("01:00:5e:01:02:03",), ("aa:bb:cc:dd:ee:ff",)], "m string")
    assert [r[0] for r in macs.select(text.is_device(F.col("m"))).collect()] == [False, False, False, True]


def test_stability_mode(spark):
    rows = [("a", k, r) for k, r in enumerate([0.1, 0.2, 0.2, 0.1, 0.3])]
    r = infer.stability(spark.createDataFrame(rows, "client_id string, replicate long, target_rate double")).first()
    assert (r["mode_rate"], r["mode_share"], r["median"]) == (0.1, 0.4, 0.2)
