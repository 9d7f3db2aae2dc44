"""Replicates by counts against replicates of rows."""

import hashlib
import math

import numpy as np
import pytest

from fleetward.operators import resampling

GRID = (0.0, 0.01, 0.1, 0.3, 1.0)


def fleet(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in (("a", 80), ("b", 57), ("quiet", 0)):
        rows += [(c, "benign_frontier", None, float(x)) for x in rng.integers(0, 25, n)]
        for s, m in (("x", 60), ("y", 51)):
            rows += [(c, "attack_validation", s, float(x)) for x in rng.integers(10, 40, m)]
    return rows + [("a", "attack_validation", "x", float("nan")), ("a", "benign_frontier", None, None), ("a", "benign_test", None, 99.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "client_id string, split string, attack_subtype string, score double")


def own(rows, client, split, subtype=None):
    return np.array([s for c, p, k, s in rows if (c, p, k) == (client, split, subtype) and s is not None])


def test_equals_replicates_of_rows(spark):
    rows = fleet()

    class Explicit(resampling.Draws):
        """Draws every row, by its rank among the sorted ones."""

        def ranks(self, replicate, client, n, wanted):
            return np.sort(self.stream(replicate, client).integers(1, n + 1, n))[np.asarray(wanted, dtype=int) - 1] if n else np.empty(0, dtype=int)

        def hits(self, replicate, client, subtype, rows, above):
            drawn = self.stream(replicate, client, subtype).integers(1, rows + 1, rows)
            return np.array([(drawn <= a).sum() for a in above])

    draws = Explicit(3, 0.02)
    got = {(r["client_id"], r["replicate"], r["grid_ix"], r["attack_subtype"]): (r["tp"], r["fn"]) for r in resampling.resampled_confusions(frame(spark, rows), draws, 6, GRID).collect()}
    assert len(got) == 3 * 6 * len(GRID) * 2
    for c in ("a", "b", "quiet"):
        benign = np.sort(own(rows, c, "benign_frontier"))
        for r in range(6):
            sample = benign[np.sort(draws.stream(r, c).integers(1, len(benign) + 1, len(benign))) - 1] if len(benign) else benign
            for s in ("x", "y"):
                attack = own(rows, c, "attack_validation", s)
                falling = np.sort(np.where(np.isnan(attack), -np.inf, attack))[::-1]
                hits = falling[draws.stream(r, c, s).integers(1, len(attack) + 1, len(attack)) - 1]
                for g, rate in enumerate(GRID):
                    k = math.ceil((len(sample) + 1) * (1 - rate))
                    at = math.inf if rate == 0 or k > len(sample) else -math.inf if k < 1 else sample[k - 1]
                    tp = int(((hits > at) & (hits > -math.inf)).sum())
                    assert got[c, r, g, s] == (tp, len(attack) - tp), (c, r, g, s)


@pytest.mark.parametrize("n, wanted", [(1, [1]), (10, [1, 5, 10]), (200, [180, 199, 200])])
def test_ranks_are_distributed_as_draws(n, wanted):
    """Means and deviations of order statistics, and of their steps, over many replicates."""
    draws = resampling.Draws(1, 0.01)
    got = np.array([draws.ranks(r, "c", n, np.array(wanted)) for r in range(4000)])
    rng = np.random.default_rng(5)
    want = np.sort(rng.integers(1, n + 1, (4000, n)), axis=1)[:, np.array(wanted) - 1]
    assert got.min() >= 1 and got.max() <= n and (np.diff(got, axis=1) >= 0).all()
    for a, b in [(got, want), (np.diff(got, axis=1), np.diff(want, axis=1))][: len(wanted)]:
        assert np.allclose(a.mean(axis=0), b.mean(axis=0), atol=4 * (b.std(axis=0) + 0.05).max() / math.sqrt(2000))
        assert np.allclose(a.std(axis=0), b.std(axis=0), rtol=0.15, atol=0.05)


def test_hits_are_distributed_as_draws():
    draws = resampling.Draws(1, 0.01)
    above = np.array([0, 3, 3, 20, 50])
    got = np.array([draws.hits(r, "c", "s", 50, above) for r in range(4000)])
    assert (got[:, 0] == 0).all() and (got[:, 4] == 50).all() and (got[:, 1] == got[:, 2]).all() and (np.diff(got, axis=1) >= 0).all()
    assert np.allclose(got.mean(axis=0), above, atol=0.3)
    assert np.allclose(got.var(axis=0), 50 * (above / 50) * (1 - above / 50), rtol=0.12)


def test_seeds():
    want = int.from_bytes(hashlib.sha256(b"7:0.02:3").digest()[:8], "big")
    assert resampling.replicate_seed(7, 0.02, 3) == want
    one, two = resampling.Draws(7, 0.02), resampling.Draws(7, 0.02)
    assert (one.ranks(3, "c", 50, np.arange(1, 51)) == two.ranks(3, "c", 50, np.arange(1, 51))).all()
    assert (one.ranks(3, "c", 50, np.arange(1, 51)) != one.ranks(4, "c", 50, np.arange(1, 51))).any()


def test_rates_are_those_of_the_solver(spark):
    """Each replicate's rates are what the macro policy gives its utilities; reruns agree; ineligible devices take no part."""
    from fleetward.operators import frontier
    from fleetward.plans import solver

    rows = fleet(1) + [("small", "benign_frontier", None, 1.0), ("small", "attack_validation", "x", 2.0)]
    df, draws = frame(spark, rows), resampling.Draws(5, 0.2)
    weights = frontier.equal_weights(df.select("client_id").distinct())
    got = {(r["client_id"], r["replicate"]): r["target_rate"] for r in resampling.replicate_rates(df, weights, draws, 4, GRID[:4], min_rows=50).collect()}
    conf = resampling.resampled_confusions(df, draws, 4, GRID[:4]).toPandas()
    people = ["a", "b", "quiet"]
    for r in range(4):
        u = np.zeros((3, 4))
        v = np.zeros((3, 4))
        for i, c in enumerate(people):
            for g in range(4):
                x = conf[(conf.client_id == c) & (conf.replicate == r) & (conf.grid_ix == g)]
                p = x.tp / (x.tp + x.fn)
                u[i, g], v[i, g] = p.mean(), (p * (1 - p) / (x.tp + x.fn)).sum() / len(x) ** 2
        choice = solver.solve_macro(np.array(GRID[:4]), u, v, np.full(3, 0.25), 0.2 - 0.25 * 0.05)["choice"]
        assert [got[c, r] for c in people] == [GRID[j] for j in choice]
    assert {c for c, _ in got} == {*people}
