"""Queries of solved problems against enumeration of all choices, and of the runs that they feed."""

import itertools
import os

import numpy as np
import pytest

from fleetward import queries as q
from fleetward.operators import frontier, policies, scoring
from fleetward.plans.solver import DELTA, EPS, TIGHT, tail_size

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def problem(points):
    p = points.toPandas().sort_values(["client_id", "grid_ix"])
    clients = sorted(p.client_id.unique())
    shape = (len(clients), -1)
    take = lambda c: p[c].to_numpy().reshape(shape)
    return clients, take("target_rate")[0], take("utility"), take("utility_variance"), take("weight")[:, 0].astype(float), take("forbidden").astype(bool), float(p.budget.iloc[0])


def choices(n, rates, w, forbidden, budget):
    every = np.array(list(itertools.product(range(len(rates)), repeat=n)))
    cost = (w * rates[every]).sum(axis=1)
    ok = (cost <= budget + TIGHT) & ~forbidden[np.arange(n), every].any(axis=1)
    return every[ok], cost[ok]


def rates_of(df):
    return {r["client_id"]: (r["grid_ix"], r["target_rate"], r["status"]) for r in df.collect()}


@pytest.fixture(scope="module")
def points(spark):
    from fleetward.staging import staged

    return staged(q.solver_points(spark, SF, guard=True), "points")


def test_macro_and_greedy(spark, points):
    clients, rates, u, v, w, _, budget = problem(points)
    none = np.zeros(u.shape, dtype=bool)
    every, cost = choices(len(clients), rates, w, none, budget)
    mean, spread = (x[np.arange(len(clients)), every].sum(axis=1) / len(clients) for x in (u, v))
    best = mean.max()
    least = cost[mean >= best - EPS + DELTA - 1e-12].min()
    calm = spread[(mean >= best - EPS + DELTA - 1e-12) & (cost <= least + EPS - DELTA + TIGHT)].min()
    first = every[(mean >= best - EPS - 1e-12) & (cost <= least + EPS + TIGHT) & (spread <= calm + EPS + TIGHT)][0]
    got = rates_of(policies.allocate(points, "macro"))
    assert [got[c][0] for c in clients] == first.tolist()
    # Greedy, step by step.
    at, left = [0] * len(clients), budget
    while True:
        steps = []
        for k, j in enumerate(at):
            if j + 1 < len(rates) and rates[j + 1] <= 0.05 + TIGHT:
                price, gain = w[k] * (rates[j + 1] - rates[j]), u[k][j + 1] - u[k][j]
                if price <= left + TIGHT:
                    steps.append((-gain / price, -gain, price, k))
        if not steps:
            break
        _, _, price, k = min(steps)
        at[k] += 1
        left -= price
    got = rates_of(policies.allocate(points, "greedy"))
    assert [got[c][0] for c in clients] == at


@pytest.mark.parametrize("conservative", [False, True])
def test_minimax(spark, points, conservative):
    """Feasible, no forbidden rate, and the two worst within the slack of the best that there is; so too on lower bounds."""
    own = points
    if conservative:
        s = q.split_scores(spark, SF)
        low = scoring.conservative_utilities(frontier.confusions(s))
        own = points.drop("utility", "utility_variance").join(low.select("client_id", "grid_ix", "utility", "utility_variance"), ["client_id", "grid_ix"])
    clients, rates, u, _, w, forbidden, budget = problem(own)
    every, _ = choices(len(clients), rates, w, forbidden, budget)
    size = tail_size(len(clients))
    worst = np.sort(u[np.arange(len(clients)), every], axis=1)[:, :size].sum(axis=1)
    got = rates_of(policies.allocate(own, "minimax"))
    at = np.array([got[c][0] for c in clients])
    assert (w * rates[at]).sum() <= budget + TIGHT and not forbidden[np.arange(len(clients)), at].any()
    reached = np.sort(u[np.arange(len(clients)), at])[:size].sum()
    assert reached >= worst.max() - size * EPS - 1e-9
    mean = u[np.arange(len(clients)), every].mean(axis=1)[worst >= worst.max() - size * EPS - 1e-12].max()
    assert u[np.arange(len(clients)), at].mean() >= mean - 2 * EPS


def test_conservative_query(spark):
    got = q.QUERIES["o22_conservative_allocation"](spark, SF).collect()
    by = {}
    for r in got:
        by.setdefault(r["policy"], {})[r["client_id"]] = r
    assert set(by) == {"macro", "minimax"} and len({frozenset(x) for x in by.values()}) == 1
    assert all(sum(r["target_rate"] for r in x.values()) / len(x) <= q.BUDGET + TIGHT for x in by.values())
    curves = q.QUERIES["o21_conservative_curves"](spark, SF).toPandas()
    plain = q.QUERIES["a05_client_utility"](spark, SF).toPandas()
    both = curves.merge(plain, on=["client_id", "grid_ix"], suffixes=("", "_plain"))
    assert len(both) == len(curves) and (both.utility <= both.utility_plain + 1e-9).all()


def test_runs_and_what_hangs_on_them(spark):
    """All policies: equal rate and equal alert as in the query that SQL confirms; contrasts recomputed from the table."""
    evals = q.QUERIES["o10_all_policies"](spark, SF).toPandas()
    assert len(evals) == 3 * 3 * len(policies.POLICIES) and set(evals.policy) == set(policies.POLICIES)
    known = q.QUERIES["o10_seed_evaluations"](spark, SF).toPandas()
    both = known.merge(evals, on=["seed", "budget_id", "policy"], suffixes=("", "_run"))
    assert len(both) == len(known)
    for c in ("macro_recall", "worst_recall", "fleet_fpr", "usage"):
        assert np.allclose(both[c], both[f"{c}_run"], atol=1e-8, equal_nan=True)
    done = evals[evals.status == "COMPLETED"]
    primary = {(r["contrast"], r["budget_id"]): r for r in q.QUERIES["o14_primary_policies"](spark, SF).collect()}
    guard = {r["budget_id"]: r for r in q.QUERIES["o15_guardrail"](spark, SF).collect()}

    def diffs(policy, metric, budget):
        x = done[done.budget_id == budget].pivot(index="seed", columns="policy", values=metric)
        return (x[policy] - x["equal_rate"]).dropna().to_numpy()

    def flips(d):
        signed = [np.dot(s, d) / len(d) for s in itertools.product((1, -1), repeat=len(d))]
        return np.mean([abs(x) >= abs(d.mean()) - 1e-12 for x in signed])

    for (contrast, budget), r in primary.items():
        d = diffs({"macro_recall": "macro", "worst_recall": "minimax"}[contrast], contrast, budget)
        assert r["n"] == len(d) and abs(r["mean"] - d.mean()) < 1e-8 and abs(r["p"] - flips(d)) < 1e-8 and r["adjusted"] >= r["p"] - 1e-12
    for budget, r in guard.items():
        d = diffs("minimax", "macro_recall", budget)
        assert abs(r["mean"] - d.mean()) < 1e-8 and abs(r["p"] - flips(d)) < 1e-8
    boot = {r["budget_id"]: r for r in q.QUERIES["o12_bootstrap"](spark, SF).collect()}
    for budget, r in boot.items():
        d = diffs("equal_alert", "macro_recall", budget)
        assert abs(r["mean"] - d.mean()) < 1e-8 and abs(r["median"] - np.median(d)) < 1e-8 and d.min() - 1e-9 <= r["low"] <= r["mean"] <= r["high"] <= d.max() + 1e-9
