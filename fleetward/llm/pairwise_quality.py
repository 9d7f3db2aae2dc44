"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text. The chance that one document
is preferred to another is the logistic function of the difference of their strengths, so
weights are learnt by logistic loss on feature differences of pairs (a document labelled 1, one
labelled 0). A logistic curve over strengths, weighted by the classes' shares, turns them
into scores from 0 to 1; a quantile of all documents' scores is the threshold for keeping.

Pairs are drawn from at most PER_CLASS labelled documents of each class (a bounded sample);
everything else runs over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import held_out, stage
from fleetward.llm.labelled import class_counts, labelled_sample

PER_CLASS = 8000
PAIRS = 120_000
STEPS = 400
PENALTY = 1e-3
THRESHOLD = 0.3
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MARK = re.compile(r"[^\w\s]")


def features(text: str | None) -> list[float]:
    """Shares and logarithms that describe a text's make-up; an empty text has all zeros but its length."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 14
    letters = sum(map(len, words))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    digits = len(re.findall(r"\d", text))
    kinds = len(set(words))
    grams = list(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = text.count(".") + text.count("!") + text.count("?")
    return [
        np.log1p(n),
        letters / n / 10,
        len(_SYMBOL.findall(text)) / chars,
        len(_MARK.findall(text)) / chars,
        upper / letters,
        digits / letters,
        np.log(kinds) / np.log(n + 1),
        again / n,
        1 - len(set(grams)) / max(1, len(grams)),
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
        min(ends / n, 1.0),
        text.count("!") / n,
        max(map(len, words)) / 50,
    ]


def expand(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Standardised features, bounded, and their squares."""
    z = np.clip((x - mean) / sd, -8, 8)
    return np.hstack([z, z * z / 4])


def fit_strengths(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> dict[str, np.ndarray]:
    """Bradley-Terry weights by gradient descent with momentum on a fixed set of random pairs."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = expand(x, mean, sd)
    rng = np.random.Generator(np.random.PCG64(seed))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(z.shape[1])
    if len(good) and len(bad):
        diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        scale = np.sqrt((diff**2).mean(axis=0)) + 1e-6
        diff /= scale
        speed = np.zeros_like(w)
        for _ in range(STEPS):
            lost = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            speed = 0.9 * speed + 0.3 * (diff.T @ lost / pairs - PENALTY * w)
            w += speed
        w /= scale
    return {"mean": mean, "sd": sd, "w": w}


def fit_curve(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float, float]:
    """Logistic curve of the label over strengths, by Newton's method: scores are 1 / (1 + exp(-(a z + b)))."""
    mid, wide = float(np.average(s, weights=weight)), float(np.sqrt(np.average((s - s.mean()) ** 2, weights=weight))) + 1e-9
    z = np.column_stack([(s - mid) / wide, np.ones(len(s))])
    c = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        g = z.T @ (weight * (y - p)) - 1e-3 * c
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        c = c + np.clip(np.linalg.solve(h, g), -2, 2)
    return mid, wide, float(c[0]), float(c[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """The model, from at most per_class labelled documents of each class; without labels all scores are equal."""
    n0, n1 = class_counts(labels, "quality")
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "quality", per_class, 1)
    rows = sample.select("text", "y").mapInPandas(_feature_rows, "y int, x array<double>").toPandas()
    if rows.empty:
        return {"model": None, "low_share": 0.0}
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    model = fit_strengths(x, y)
    s = expand(x, model["mean"], model["sd"]) @ model["w"]
    share = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    model["curve"] = fit_curve(s, y, share / share.sum() * len(s))
    return {"model": model, "low_share": n0 / max(1, n0 + n1)}


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"y": b["y"], "x": [features(t) for t in b["text"]]})


def _scored_rows(model: dict | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if model is None:
                score = np.full(len(b), 0.5)
            else:
                x = np.array([features(t) for t in b["text"]]).reshape(len(b), -1)
                mid, wide, a, c = model["curve"]
                s = expand(x, model["mean"], model["sd"]) @ model["w"] if len(b) else np.empty(0)
                score = 1 / (1 + np.exp(-np.clip(a * (s - mid) / wide + c, -30, 30)))
            yield b.drop(columns="text").assign(score=score)

    return run


def score(docs: DataFrame, labels: DataFrame, drop_share: float | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, kept.

    predicted: 1 if score >= 0.3. kept: score is not below the quantile drop_share of all scores (unset: the share
    of label 0). Null and empty texts are scored by their features, all zero; ties at the quantile are kept;
    repeated rows score alike; null ids are not held out; empty docs give no rows, empty labels the score 0.5.
    """
    fitted = fit(docs, labels, per_class)
    # Ids pass as text: pandas would make floating-point numbers of them beside a null.
    rows = docs.select(F.col("doc_id").cast("string"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(_scored_rows(fitted["model"]), "doc_id string, held_out boolean, score double")
    scored = stage(rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "quality-scores")
    share = fitted["low_share"] if drop_share is None else drop_share
    cut = scored.agg(F.percentile_approx("score", F.lit(float(share)), F.lit(100_000))).first()[0]
    return scored.withColumns({"predicted": (F.col("score") >= THRESHOLD).cast("int"), "kept": F.col("score") >= (cut if cut is not None else 0.0)})
