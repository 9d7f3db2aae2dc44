"""Resampling of scores as counts: what a bootstrap replicate needs, without drawing its rows.

A replicate draws each partition anew with replacement. Of a device's n benign scores it needs
the order statistics that set thresholds: the k-th least of n draws is the row of rank
ceil(n U), U the k-th least of n uniform numbers, and those are drawn jointly, one beta variate
each. Of a subtype's m attack scores it needs how many draws lie above each threshold: a
multinomial over the counts between thresholds. So a replicate costs a device as many numbers
as the grid has rates, whatever its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.operators import frontier
from fleetward.operators.calibrate import TIGHT, rank_of
from fleetward.operators.ranking import positions, running_sums


def replicate_seed(seed: int, budget: float, replicate: int) -> int:
    """The first eight bytes of SHA-256 of seed:budget:replicate."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{budget}:{replicate}".encode()).digest()[:8], "big")


class Draws:
    """The random numbers of a study: each replicate, device and subtype has a stream of its own, whatever task asks."""

    def __init__(self, seed: int, budget: float) -> None:
        self.seed, self.budget = seed, budget

    def stream(self, replicate: int, *names: str) -> np.random.Generator:
        more = [int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "big") for x in names]
        return np.random.default_rng([replicate_seed(self.seed, self.budget, replicate), *more])

    def ranks(self, replicate: int, client: str, n: int, wanted: np.ndarray) -> np.ndarray:
        """Rows' ranks (1 to n) that the wanted ones (ascending, 1 to n) of n draws take."""
        rng, out, last, u = self.stream(replicate, client), [], 0, 0.0
        for k in wanted.tolist():
            if k > last:
                u += (1 - u) * rng.beta(k - last, n - k + 1)
                last = k
            out.append(min(n, int(np.floor(u * n)) + 1))
        return np.array(out, dtype=np.int64)

    def hits(self, replicate: int, client: str, subtype: str, rows: int, above: np.ndarray) -> np.ndarray:
        """Of as many draws as rows, those above each threshold; above: rows above them, rising."""
        cells = np.diff(np.r_[0, above, rows])
        return np.cumsum(self.stream(replicate, client, subtype).multinomial(rows, cells / rows))[:-1]


def _ranked(draws: Draws):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for client, replicate, n, ranks in zip(b["client_id"], b["replicate"], b["n"], b["ranks"], strict=True):
                k = np.asarray(ranks, dtype=np.int64)
                inside = np.unique(k[(k >= 1) & (k <= n)])
                got = dict(zip(inside.tolist(), draws.ranks(replicate, client, n, inside).tolist(), strict=True))
                out += [(client, replicate, g, got.get(x, 0)) for g, x in enumerate(k.tolist())]
            yield pd.DataFrame(out, columns=["client_id", "replicate", "grid_ix", "position"])

    return run


def _counted(draws: Draws):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits = [draws.hits(r, c, s, n, np.asarray(above, dtype=np.int64)).tolist() for c, r, s, n, above in zip(b["client_id"], b["replicate"], b["attack_subtype"], b["n"], b["above"], strict=True)]
            yield pd.DataFrame({"client_id": b["client_id"], "replicate": b["replicate"], "attack_subtype": b["attack_subtype"], "n": b["n"], "tp": hits})

    return run


def resampled_confusions(scores: DataFrame, draws: Draws, replicates: int, grid: tuple[float, ...] = frontier.GRID) -> DataFrame:
    """(client_id, replicate, grid_ix, target_rate, attack_subtype, tp, fn): frontier.confusions() of each replicate.

    scores: client_id, split, attack_subtype, score. Rows are sorted and counted once; tables that grow with
    replicates are of devices times replicates times rates, and no row meets a replicate. Null scores are left out,
    NaN alerts never.
    """
    col = F.col
    known = scores.where(col("score").isNotNull())
    benign = known.where(col("split") == "benign_frontier").select("client_id", "score")
    attack = known.where(col("split") == "attack_validation").select("client_id", "attack_subtype", "score")
    sizes = attack.groupBy("client_id", "attack_subtype").agg(F.count("*").alias("n"))
    n_benign = benign.groupBy("client_id").agg(F.count("*").alias("n"))
    people = sizes.select("client_id").distinct().join(n_benign, "client_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    # A rate of 0 asks for a rank above all.
    ranks = F.array(*(rank_of(col("n"), F.lit(float(a))) if a > TIGHT else col("n") + 1 for a in grid))
    each = people.select("client_id", "n", ranks.alias("ranks"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = each.mapInPandas(_ranked(draws), "client_id string, replicate int, grid_ix int, position long")
    row_at = positions(benign, ["client_id"], "score").select("client_id", "position", col("score").alias("threshold"))
    cut = drawn.join(row_at, ["client_id", "position"], "left")
    # Outside of 1 to n: never (rank above all), or always (rank below all).
    rates = F.array(*map(F.lit, map(float, grid)))
    cut = cut.withColumn("threshold", F.coalesce("threshold", F.when(F.get(rates, "grid_ix") >= 1.0, float("-inf")).otherwise(float("inf"))))

    asked = cut.select("client_id", "threshold").distinct().join(sizes.select("client_id", "attack_subtype"), "client_id")
    keys = ["client_id", "attack_subtype"]
    both = attack.where(~F.isnan("score")).select(*keys, "score", F.lit(1).alias("p")).unionByName(asked.select(*keys, col("threshold").alias("score"), F.lit(0).alias("p")))
    above = running_sums(both.groupBy(*keys, "score").agg(F.sum("p").alias("p")), keys, "score", {"above": "p"}, descending=True)
    above = above.select(*keys, col("score").alias("threshold"), "above")
    per = cut.join(above, ["client_id", "threshold"]).groupBy(*keys, "replicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("grid_ix", "above"))), lambda x: x["above"]).alias("above"))
    counted = per.join(sizes, keys).select("client_id", "replicate", "attack_subtype", "n", "above").mapInPandas(_counted(draws), "client_id string, replicate int, attack_subtype string, n long, tp array<long>")
    return counted.select("client_id", "replicate", "attack_subtype", "n", F.posexplode("tp").alias("grid_ix", "tp")).select("client_id", "replicate", "grid_ix", F.get(rates, "grid_ix").alias("target_rate"), "attack_subtype", "tp", (col("n") - col("tp")).alias("fn"))


def replicate_rates(scores: DataFrame, weights: DataFrame, draws: Draws, replicates: int, grid: tuple[float, ...] = frontier.GRID, min_client: int = 100, min_rows: int = 50, cap: float = 0.05) -> DataFrame:
    """(client_id, replicate, target_rate): the macro policy's rates in each replicate, of devices that are eligible.

    Sizes, and so eligibility and what the others reserve, are those of the scores: a replicate has as many rows.
    """
    from fleetward.operators.policies import allocate
    from fleetward.staging import staged

    conf = staged(resampled_confusions(scores, draws, replicates, grid), "resampled")
    able = frontier.eligibility(conf.where(F.col("replicate") == 0), min_client, min_rows=min_rows)
    people = scores.select("client_id").distinct().join(able.select("client_id", "eligible"), "client_id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    people = staged(people.join(weights, "client_id"), "eligible")
    left = frontier.fallback_budget(people.select("client_id", "eligible"), people.select("client_id", "weight"), draws.budget, cap).first()
    util = frontier.utilities(conf, min_rows, ("client_id", "replicate")).join(people.where("eligible").select("client_id", "weight"), "client_id")
    points = util.withColumns({"budget": F.lit(float(left["remaining"] if left["remaining"] is not None else draws.budget)), "forbidden": F.lit(False)})
    return allocate(points, "macro", ("replicate",)).where(F.col("target_rate").isNotNull()).select("client_id", "replicate", "target_rate")
