"""Stretches of time against whole runs of alerts, and bisection against the plain one."""

import itertools

import numpy as np
import pytest

from fleetward.operators import event_budget as eb

RULE = eb.Rule(5.0, 3.0, 12.0)


def plain(t, rule):
    if not len(t):
        return 0
    cut = np.flatnonzero(np.diff(t) > rule.gap)
    start, end = t[np.r_[0, cut + 1]], t[np.r_[cut, len(t) - 1]]
    ok = end - start >= rule.least
    start, end = start[ok], end[ok]
    return int(len(start) and 1 + (start[1:] - end[:-1] >= rule.cooldown).sum())


@pytest.mark.parametrize("seed", range(30))
def test_stretches_join_in_any_grouping(seed):
    rng = np.random.default_rng(seed)
    rule = eb.Rule(float(rng.choice([0, 2, 5])), float(rng.choice([0, 1, 4])), float(rng.choice([0, 6, 15])))
    t = np.sort(rng.integers(0, [15, 60, 300][seed % 3], rng.integers(0, 40)).astype(float))
    for _ in range(20):
        cuts = np.sort(rng.integers(0, len(t) + 1, rng.integers(0, 6)))
        parts = [eb.summary(x, rule) for x in np.split(t, cuts)]
        while len(parts) > 1:
            k = int(rng.integers(0, len(parts) - 1))
            parts[k : k + 2] = [eb.join(parts[k], parts[k + 1], rule)]
        assert eb.events_of(parts[0], rule) == plain(t, rule)


def bisected(rows, per_hour, rule, steps=24):
    out = {}
    for c in {r[0] for r in rows if r[1] == "benign"}:
        times = [t for d, _, t, _ in rows if d == c]
        own = sorted((t, s) for d, k, t, s in rows if d == c and k == "benign")
        t, s = np.array([x for x, _ in own]), np.array([x for _, x in own])
        hours = (max(times) - min(times)) / 3600.0
        rate = lambda x: plain(t[s > x], rule) / hours
        if hours <= 0:
            out[c] = None
            continue
        low, high = float(s.min()), float(s.max())
        if low == high:
            out[c] = low
            continue
        for _ in range(steps):
            mid = (low + high) / 2.0
            low, high = (low, mid) if rate(mid) <= per_hour else (mid, high)
        out[c] = high if rate(high) <= per_hour else None
    return out


@pytest.mark.parametrize("per_hour, shuffled", [(0.5, False), (3.0, True), (0.0, False)])
def test_thresholds_equal_plain_bisection(spark, monkeypatch, per_hour, shuffled):
    """Devices over several ranges and batches, with few and many stretches; one of one moment, one of one score."""
    monkeypatch.setattr(eb, "TOGETHER", 3)
    if shuffled:
        monkeypatch.setattr(eb, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(int(per_hour * 10))
    rows = [("big", "benign", float(t), float(s)) for t, s in zip(rng.integers(0, 40_000, 900), rng.exponential(1, 900).round(3), strict=True)]
    rows += [("small", ["benign", "attack"][k % 3 == 0], float(rng.integers(0, 9000)), float(rng.random())) for k in range(60)]
    rows += [("flat", "benign", float(k), 2.0) for k in range(5)] + [("moment", "benign", 7.0, float(k)) for k in range(5)] + [("none", "attack", float(k), 1.0) for k in range(3)]
    df = spark.createDataFrame(rows, "client_id string, label string, t double, score double").repartition(3)
    parameters = (20.0, 30.0, 10.0, 100.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r["client_id"]: r["threshold"] for r in eb.thresholds(df, per_hour, parameters, steps=10).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == bisected(rows, per_hour, eb.Rule(30.0, 10.0, 100.0), steps=10)


def test_tree_holds_every_middle():
    for answers in itertools.product((True, False), repeat=3):
        low, high, k, tree = 0.0, 1.0, 0, eb._tree(0.0, 1.0, 3)
        for fits in answers:
            mid = (low + high) / 2
            assert tree[k] == mid
            low, high, k = (low, mid, 2 * k + 1) if fits else (mid, high, 2 * k + 2)
