"""Standardising, scoring and combining feature vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.operators.ranking import running_sums

FLAT = 1e-12


def column_statistics(feat: DataFrame) -> DataFrame:
    """(client_id, feature, mean, sd): population deviation, 1 where a feature is flat."""
    long = feat.select("client_id", F.posexplode("x").alias("feature", "v"))
    out = long.groupBy("client_id", "feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return out.withColumn("sd", F.when(F.col("sd") < FLAT, 1.0).otherwise(F.col("sd")))


def standardise(feat: DataFrame, stats: DataFrame) -> DataFrame:
    """feat with z, the standardised vector; statistics travel as one row a device."""
    arrays = stats.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "sd"))).alias("s"))
    out = feat.join(F.broadcast(arrays), "client_id")
    return out.withColumn("z", F.zip_with("x", "s", lambda v, s: (v - s["mean"]) / s["sd"])).drop("s")


def mean_square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def ecdf(pool: DataFrame, query: DataFrame, keys: list[str], value: str) -> DataFrame:
    """query with pct: the share of the pool (same keys) that is not above the value."""
    both = pool.select(*keys, value, F.lit(1).alias("p")).unionByName(query.select(*keys, value, F.lit(0).alias("p")))
    at = both.groupBy(*keys, value).agg(F.sum("p").alias("p"))
    run = running_sums(at, keys, value, {"before": "p"})
    size = pool.groupBy(*keys).agg(F.count("*").alias("size"))
    pct = run.join(F.broadcast(size), keys).select(*keys, value, ((F.col("before") + F.col("p")) / F.col("size")).alias("pct"))
    return query.join(pct, [*keys, value])


def layers(sizes: list[int], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights of a symmetric autoencoder: sizes down to the bottleneck, then back."""
    rng = np.random.default_rng(seed)
    path = [*sizes, *sizes[-2::-1]]
    return [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(path[:-1], path[1:], strict=True)]


def forward(net: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """Activations of each layer; linear at the bottleneck and at the end, ReLU between."""
    out = [x]
    for k, (w, b) in enumerate(net):
        x = x @ w + b
        if k + 1 not in (len(net) // 2, len(net)):
            x = np.maximum(x, 0)
        out.append(x)
    return out


def train_local(net, x: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 1e-3, seed: int = 0):
    """Adam on mean squared error over shuffled batches."""
    net = [(w.copy(), b.copy()) for w, b in net]
    rng = np.random.default_rng(seed)
    flat = [p for layer in net for p in layer]
    m, v, t = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            act = forward(net, x[order[a : a + batch]])
            g = 2 * (act[-1] - act[0]) / act[0].size
            grads: list[np.ndarray] = []
            for k in range(len(net) - 1, -1, -1):
                if k + 1 not in (len(net) // 2, len(net)):
                    g = g * (act[k + 1] > 0)
                grads = [act[k].T @ g, g.sum(axis=0), *grads]
                g = g @ net[k][0].T
            t += 1
            for p, d, mm, vv in zip(flat, grads, m, v, strict=True):
                mm += 0.1 * (d - mm)
                vv += 0.001 * (d * d - vv)
                p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return net


def average_models(models: list[tuple[int, list]]):
    """Federated mean of model states, weighted by rows."""
    total = sum(n for n, _ in models)
    return [(sum(n * m[k][0] for n, m in models) / total, sum(n * m[k][1] for n, m in models) / total) for k in range(len(models[0][1]))]


def _local_round(state, epochs: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows.sort_values("row")["z"].tolist(), dtype=np.float64)
        new = train_local(state, x, epochs, seed=seed)
        return pd.DataFrame({"client_id": [rows["client_id"].iat[0]], "n": [len(x)], "state": [np.concatenate([p.ravel() for layer in new for p in layer]).tolist()]})

    return run


def federated_training(feat: DataFrame, sizes: list[int], rounds: int = 10, epochs: int = 3, seed: int = 0):
    """Rounds of local training by device, averaged on the driver: one model state a device and round comes back.

    feat: client_id, row, z. A device's training rows are one group, as its local training is sequential.
    """
    net = layers(sizes, seed)
    for r in range(rounds):
        got = feat.groupBy("client_id").applyInPandas(_local_round(net, epochs, seed * 1000 + r), "client_id string, n long, state array<double>").orderBy("client_id").collect()
        if not got:
            return net
        models = []
        for row in got:
            flat, at, model = np.array(row["state"]), 0, []
            for w, b in net:
                model.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
                at += w.size + b.size
            models.append((row["n"], model))
        net = average_models(models)
    return net


def reconstruction_scores(feat: DataFrame, net) -> DataFrame:
    """feat with score: the mean squared error of reconstructing z."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for z in batches:
            x = np.array(z.tolist(), dtype=np.float64).reshape(len(z), -1)
            yield pd.Series(((forward(net, x)[-1] - x) ** 2).mean(axis=1) if len(z) else np.empty(0))

    return feat.withColumn("score", F.pandas_udf(run, "double")("z"))


def ensemble(scores: DataFrame, pool: Column, first: str, second: str) -> DataFrame:
    """Adds score: the greater of two percentiles in the pool of the same client."""
    own = scores.withColumn("__id", F.struct("client_id", "row"))
    for c in (first, second):
        part = own.select("client_id", "row", F.col(c).alias("v"), pool.alias("in_pool"))
        pct = ecdf(part.where("in_pool").select("client_id", "v"), part.select("client_id", "v").distinct(), ["client_id"], "v")
        own = own.join(pct.select("client_id", F.col("v").alias(c), F.col("pct").alias(f"{c}_pct")), ["client_id", c])
    return own.drop("__id").withColumn("score", F.greatest(f"{first}_pct", f"{second}_pct"))


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction (Lentz), for a, b >= 1."""
    x, a, b = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(a, dtype=float), np.asarray(b, dtype=float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return np.where(flip, 1 - front * h, front * h)


def binomial_lower_bound(tp: np.ndarray, fn: np.ndarray, confidence: float) -> np.ndarray:
    """One-sided exact lower bound of a share: the p at which tp or more of n has probability 1 - confidence; 0 if tp = 0.

    That probability is I_p(tp, fn + 1), so the cost doesn't grow with the counts.
    """
    tp, fn = np.asarray(tp, dtype=float), np.asarray(fn, dtype=float)
    lo, hi = np.zeros(len(tp)), np.ones(len(tp))
    for _ in range(60):
        mid = (lo + hi) / 2
        small = beta_share(mid, np.maximum(tp, 1), fn + 1) < 1 - confidence
        lo, hi = np.where(small, mid, lo), np.where(small, hi, mid)
    return np.where(tp == 0, 0.0, (lo + hi) / 2)


def conservative_utilities(conf: DataFrame, confidence: float = 0.95, min_rows: int = 50) -> DataFrame:
    """Utilities from lower bounds instead of shares; the distinct (tp, fn) pairs are few."""

    def run(tp: pd.Series, fn: pd.Series) -> pd.Series:
        return pd.Series(binomial_lower_bound(tp.to_numpy(), fn.to_numpy(), confidence))

    kept = conf.where(F.col("tp") + F.col("fn") >= min_rows)
    bound = F.pandas_udf(run, "double")("tp", "fn")
    n = (F.col("tp") + F.col("fn")).cast("double")
    p = F.col("tp") / n
    out = kept.withColumn("low", bound).groupBy("client_id", "grid_ix", "target_rate")
    return out.agg(F.avg("low").alias("utility"), (F.sum(p * (1 - p) / n) / F.pow(F.count("*"), F.lit(2))).alias("utility_variance"))

