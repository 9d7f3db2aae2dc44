"""Toxicity: maximum-scoring segments of token log-odds, with extreme-value calibration.

Tokens get log-odds of standing in a toxic document, with Dirichlet priors: a word's prior is
what is known of its first six bytes, theirs what is known of its first four, theirs the
overall rate; so inflected and compounded words share evidence. A word said again at once tells
nothing that the first did not, so its log-odds are 0. Counts are kept in tables of
fixed size by hash, so a model has a fixed size whatever the vocabulary.

A drift is taken from each score so that clean text scores below zero on the whole. One linear
scan finds all maximal-scoring segments of a document. With the scores' exponent lambda on
clean text, a segment's tail is K n exp(-lambda S), and the segments whose expected number by
chance is at most EXPECTED are the significant passages. A document's score is a logistic
curve over the best segment's normalised score, the sum over passages, and its length.

Counts and curve come from at most PER_CLASS labelled documents of each class, the counts
from three quarters of them and the calibration from the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import held_out
from fleetward.llm.labelled import class_counts, labelled_sample
from fleetward.llm.tokens import _BYTE, mix, powers, slices, word_bounds, word_hashes

PER_CLASS = 10_000
#: Table sizes: words, first six bytes, first four bytes.
TABLES = (1 << 20, 1 << 18, 1 << 16)
PRIOR = 4.0
DRIFT = 1.0
EXPECTED = 0.05
THRESHOLD = 0.5
#: Texts whose words are held at once.
AT_ONCE = 200
_WORD = re.compile(r"[^\W\d_]+")


def token_cells(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cells in the three tables of every word of every text (words x 3), and words in each text."""
    words = [_WORD.findall((t or "").lower()) for t in texts]
    data = np.frombuffer("\n".join(w for ws in words for w in ws).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_bounds(data)
    lengths = ends - starts
    whole = word_hashes(data, starts, ends)
    cells = [whole % np.uint64(TABLES[0])]
    padded = np.r_[data, np.zeros(8, dtype=np.uint8)]
    pw = powers(0xA24BAED4963EE407, 6)
    for n, size in ((6, TABLES[1]), (4, TABLES[2])):
        h = np.zeros(len(starts), dtype=np.uint64)
        for j in range(n):
            h += np.where(j < lengths, _BYTE[padded[starts + j]] * pw[j], np.uint64(0))
        cells.append(mix(h + np.uint64(n)) % np.uint64(size))
    return np.stack(cells, axis=1).astype(np.int64) if len(starts) else np.empty((0, 3), dtype=np.int64), np.array([len(w) for w in words], dtype=np.int64)


def log_odds(cells: np.ndarray, toxic: list[np.ndarray], every: list[np.ndarray], rate: float) -> np.ndarray:
    """Log-odds against the overall rate; the prior of each level is the level above."""
    p = np.full(len(cells), rate)
    for level in (2, 1, 0):
        c = cells[:, level]
        p = (toxic[level][c] + PRIOR * p) / (every[level][c] + PRIOR)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p)) - np.log(rate / (1 - rate))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in linear time.

    Positive runs are taken from left to right. A candidate merges with an earlier one that starts lower and ends
    lower than it does, in running sums; the nearest earlier start that is lower is kept for each candidate.
    """
    up = scores > 0
    if not up.any():
        return []
    total = np.r_[0.0, np.cumsum(scores)]
    edge = np.diff(np.r_[0, up.astype(np.int8), 0])
    stack: list[list[float]] = []  # first, end, sum before, sum after, index of the nearest candidate that starts lower
    for first, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        low, high = float(total[first]), float(total[end])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = int(stack[j][4])
            if j < 0 or stack[j][3] >= high:
                stack.append([first, end, low, high, j])
                break
            first, low = int(stack[j][0]), stack[j][2]
            del stack[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi, _ in stack]


def fit_lambda(scores: np.ndarray) -> float:
    """The exponent at which clean tokens' scores have mean exp(lambda s) = 1, by bisection."""
    if not (scores > 0).any() or scores.mean() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while np.exp(np.clip(hi * scores, None, 60)).mean() < 1 and hi < 64:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.exp(np.clip(mid * scores, None, 60)).mean() < 1 else (lo, mid)
    return max((lo + hi) / 2, 1e-3)


def evidence(found: list[tuple[int, int, float]], n: int, lam: float, log_k: float) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Features of a document, and its significant passages with their normalised scores."""
    base = log_k + np.log(max(n, 1))
    normal = [(a, b, lam * s - base) for a, b, s in found]
    passages = [x for x in normal if x[2] >= -np.log(EXPECTED)]
    best = max((x[2] for x in normal), default=-base)
    # The sum statistic: what the better segments have beyond a chance segment's mean.
    beyond = sum(max(0.0, lam * s - 2.0) for _, _, s in found)
    return np.array([best, np.log1p(beyond), np.log1p(sum(x[2] for x in passages)), np.log1p(n)]), passages


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Logistic curve by Newton's method; more evidence (all features but the length) never lowers a score."""
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    use = np.ones(z.shape[1], dtype=bool)
    while True:
        c = np.zeros(z.shape[1])
        for _ in range(80):
            p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
            g = (z.T @ (weight * (y - p)) - 1e-2 * c)[use]
            h = ((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(c)))[np.ix_(use, use)]
            c[use] += np.clip(np.linalg.solve(h, g), -1, 1)
        worst = int(np.argmin(c[: x.shape[1] - 1]))
        if c[worst] >= 0:
            return {"mean": mean, "sd": sd, "c": c}
        use[worst] = False


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words counted by table, cell and label: at most a row for each cell and label of a batch."""
    for b in slices(batches, AT_ONCE):
        cells, size = token_cells(b["text"].tolist())
        y = np.repeat(b["y"].to_numpy(), size).astype(np.int64)
        for level in range(3):
            key, n = np.unique(cells[:, level] * 2 + y, return_counts=True)
            yield pd.DataFrame({"level": np.full(len(key), level), "cell": key >> 1, "y": key & 1, "n": n})


def _scores_of(model: dict, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Scores of all words of each text; a word that repeats the one before it has log-odds of 0."""
    cells, size = token_cells(texts)
    odds = log_odds(cells, model["toxic"], model["every"], model["rate"])
    border = np.cumsum(size) - size
    again = np.r_[False, (cells[1:] == cells[:-1]).all(axis=1)] if len(cells) else np.empty(0, dtype=bool)
    again[border[size > 0]] = False
    scores = np.where(again, 0.0, odds) - DRIFT
    yield from np.split(scores, border[1:]) if len(size) else ()


def _calibration_rows(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in slices(batches, AT_ONCE):
            out = []
            for y, s in zip(b["y"], _scores_of(model, b["text"].tolist()), strict=True):
                found = segments(s)
                # A histogram of the tokens' scores is enough for lambda.
                out.append((y, len(s), [x[2] for x in found], np.bincount(np.clip((s * 8).round().astype(int) + 160, 0, 320), minlength=321)))
            yield pd.DataFrame(out, columns=["y", "n", "found", "histogram"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """The model, or None if a class has no labels."""
    spark = docs.sparkSession
    n0, n1 = class_counts(labels, "toxic")
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", per_class, 2)
    later = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)) == 0
    counts = sample.where(~later).select("text", "y").mapInPandas(_count_rows, "level int, cell long, y int, n long").groupBy("level", "cell", "y").agg(F.sum("n").alias("n"))
    # At most a row for each cell and label of tables of fixed size, whatever the sample says.
    counts = counts.toPandas()
    toxic, every = ([np.zeros(size) for size in TABLES] for _ in range(2))
    for level in range(3):
        own = counts[counts["level"] == level]
        np.add.at(every[level], own["cell"].to_numpy(), own["n"].to_numpy())
        own = own[own["y"] == 1]
        np.add.at(toxic[level], own["cell"].to_numpy(), own["n"].to_numpy())
    total, bad = every[0].sum(), toxic[0].sum()
    if not bad or bad == total:
        return None
    model = {"toxic": [x.astype(np.float32) for x in toxic], "every": [x.astype(np.float32) for x in every], "rate": float(bad / total)}
    tables = spark.sparkContext.broadcast(model)
    rows = sample.where(later).select("text", "y").mapInPandas(_calibration_rows(tables), "y int, n long, found array<double>, histogram array<long>").toPandas()
    if rows.empty or rows["y"].nunique() < 2:
        return None
    rows = rows.assign(key=[(y, n, *f) for y, n, f in zip(rows["y"], rows["n"], rows["found"], strict=True)]).sort_values("key", ignore_index=True)
    clean = rows["y"] == 0
    histogram = np.array(rows["histogram"][clean].tolist()).sum(axis=0)
    at = (np.arange(321) - 160) / 8
    lam = fit_lambda(np.repeat(at, np.maximum(histogram * 100_000 // max(1, histogram.sum()), (histogram > 0).astype(int))))
    # The best segment of clean texts follows Gumbel's law: its mean gives K.
    best = [lam * max(f, default=0.0) - np.log(n) for f, n in zip(rows["found"][clean], rows["n"][clean], strict=True) if n > 20]
    model |= {"lam": lam, "log_k": float(np.mean(best) - 0.5772) if best else 0.0}
    x = np.array([evidence([(0, 0, s) for s in f], n, lam, model["log_k"])[0] for f, n in zip(rows["found"], rows["n"], strict=True)])
    y = rows["y"].to_numpy().astype(float)
    share = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum())
    return model | {"curve": _curve(x, y, share / share.sum() * len(y))}


def _scored_rows(shared, with_passages: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in slices(batches, AT_ONCE):
            if model is None:
                yield b.drop(columns="text").assign(score=0.5, n_passages=0, **({"passages": [[] for _ in range(len(b))]} if with_passages else {}))
                continue
            x, passages = [], []
            for s in _scores_of(model, b["text"].tolist()):
                f, own = evidence(segments(s), len(s), model["lam"], model["log_k"])
                x.append(f)
                passages.append(own)
            curve = model["curve"]
            z = np.hstack([(np.array(x).reshape(len(b), -1) - curve["mean"]) / curve["sd"], np.ones((len(b), 1))]) if len(b) else np.empty((0, 5))
            out = b.drop(columns="text").assign(score=1 / (1 + np.exp(-np.clip(z @ curve["c"], -30, 30))), n_passages=[len(p) for p in passages])
            if with_passages:
                out["passages"] = [[{"first": a, "end": e, "normal": float(v)} for a, e, v in p] for p in passages]
            yield out

    return run


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, with_passages: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= 0.5), n_passages, passages.

    passages (if asked for): significant segments as word positions (letters only count as words) and normalised
    scores. Null and empty texts have no segments and get the score of that; repeated rows score alike; null ids
    are not held out; empty docs give no rows; labels of one class only, or none, give the score 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))
    extra = ["n_passages", *["passages"] * with_passages]
    schema = "doc_id string, held_out boolean, score double, n_passages long" + ", passages array<struct<first:long,end:long,normal:double>>" * with_passages
    # Ids pass as text: pandas would make floating-point numbers of them beside a null.
    rows = docs.select(F.col("doc_id").cast("string"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInPandas(_scored_rows(shared, with_passages), schema)
    return rows.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *extra)
