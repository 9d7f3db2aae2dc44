"""Timed captures to scores at rest: scaler, model, scores and splits of each seed, committed together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetward.operators import scoring
from fleetward.operators.splits import ATTACK_FRACTION, BENIGN_BOUNDS, split_rows
from fleetward.sources import commits
from fleetward.sources.captures import trainable
from fleetward.staging import measured, released, staged

#: Rows with z (client_id, split, ..., z) and a seed, to the rows with score.
Model = Callable[[DataFrame, DataFrame, int], DataFrame]


def autoencoder(sizes: list[int], rounds: int = 10, epochs: int = 3) -> Model:
    """Federated training on the training rows, reconstruction error of all rows."""

    def fit_and_score(train: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
        return scoring.reconstruction_scores(rows, scoring.federated_training(train.select("client_id", F.col("ordinal").alias("row"), "z"), sizes, rounds, epochs, seed))

    return fit_and_score


def in_order(rows: DataFrame) -> DataFrame:
    """rows with ordinal, a number that rises by source_file, then source_row. Files are a table of one row each."""
    files = rows.select("source_file").distinct().withColumn("__file", F.row_number().over(Window.orderBy("source_file")).cast("long"))
    return rows.join(measured(files, "files", 512), "source_file").withColumn("ordinal", F.shiftleft("__file", 33) + F.col("source_row")).drop("__file")


def seed_scores(rows: DataFrame, model: Model, dataset: str, seed: int, bounds: tuple[float, float, float] = BENIGN_BOUNDS, attack: float = ATTACK_FRACTION) -> dict[str, DataFrame]:
    """scaler (client_id, feature, mean, sd) and scores of one seed.

    rows: timed_features() of clients that leave rows to train on. Benign rows split by their rank within the client,
    attack rows by their rank within client and subtype, in the order of file and row; the scaler is that of the
    training rows. Scores have client, file and row, by which they meet their times; a row's id is client|file|row.
    """
    own = split_rows(in_order(rows), bounds, attack)
    stats = scoring.column_statistics(own.where(F.col("split") == "benign_train"))
    z = scoring.standardise(own, stats)
    scored = model(z.where(F.col("split") == "benign_train"), z, seed)
    scores = scored.select(
        F.concat_ws("|", "client_id", "source_file", F.col("source_row").cast("string")).alias("sample_id"), F.lit(dataset).alias("dataset_id"), F.lit(seed).cast("long").alias("seed"),
        "client_id", "split", "source_file", "source_row", "label", "attack_subtype", F.col("score").cast("double").alias("score"),
    )
    return {"scaler": stats, "scores": scores}


def place(path: str, dataset: str, seed: int) -> str:
    return f"{path}/dataset={dataset}/seed={seed}"


def lacking(spark: SparkSession, path: str, dataset: str, seed: int, clients: DataFrame) -> DataFrame:
    """Clients without committed scores of the seed beside those that they were trained on."""
    have = commits.current(spark, place(path, dataset, seed)).get("scores")
    if have is None:
        return clients.select("client_id").distinct()
    return clients.select("client_id").distinct().join(have.where(F.col("split") != "benign_train").select("client_id").distinct(), "client_id", "left_anti")


def materialise(spark: SparkSession, rows: DataFrame, path: str, dataset: str, seeds: list[int], model: Model, bounds: tuple[float, float, float] = BENIGN_BOUNDS, attack: float = ATTACK_FRACTION) -> dict[int, str]:
    """Writes scaler and scores of each seed below path, partitioned by split; REUSED or WRITTEN by seed.

    A seed whose committed scores have every client is left as it is. Each seed is one commit: after a loss, what
    was done is reused and the rest is done again. Clients that leave no row to train on are left out; none left is
    an error.
    """
    out = {}
    with released(spark):
        able = staged(trainable(rows, bounds[0]), "trainable")
        if able.isEmpty():
            raise ValueError("no client has benign rows to train on")
        kept = None
        for seed in seeds:
            if lacking(spark, path, dataset, seed, able).isEmpty():
                out[seed] = "REUSED"
                continue
            kept = kept if kept is not None else staged(rows.join(able.select("client_id"), "client_id", "left_semi"), "timed-rows")
            commits.commit(spark, place(path, dataset, seed), seed_scores(kept, model, dataset, seed, bounds, attack), {"scores": ["split"]}, {"dataset": dataset, "seed": seed})
            out[seed] = "WRITTEN"
    return out


def scores_of(spark: SparkSession, path: str, dataset: str, seed: int) -> DataFrame:
    """The committed scores of a seed, of rows that no model was trained on."""
    found = commits.current(spark, place(path, dataset, seed)).get("scores")
    if found is None:
        raise ValueError(f"no scores of {dataset} at seed {seed} below {path}")
    return found.where(F.col("split") != "benign_train")


def persist_tables(spark: SparkSession, path: str, per_seed: dict[int, dict[str, DataFrame]]) -> int:
    """The event tables of all seeds, each with its seed, in one commit."""
    names = sorted({n for t in per_seed.values() for n in t})
    united = {}
    for n in names:
        for seed, tables in per_seed.items():
            if n in tables:
                one = tables[n].withColumn("seed", F.lit(seed).cast("long"))
                united[n] = one if n not in united else united[n].unionByName(one)
    return commits.commit(spark, path, united)


def event_run(spark: SparkSession, path: str, observations: dict[int, DataFrame], gate: DataFrame, budgets: dict[str, float], steps: dict[str, tuple[float, ...]], per_hour: tuple[float, ...]) -> str:
    """Event tables (metrics, robustness, gini, budgets) of all seeds and budgets, in one commit below path.

    observations: by seed, client_id, label, t, score. gate: the status of the captures' provenance. GATED if that is
    not PASS; EMPTY, and nothing written, without observations or events; else WRITTEN.
    """
    from fleetward.operators.events import event_tables

    if gate.first()["status"] != "PASS":
        return "GATED"
    with released(spark):
        tables = {}
        for seed, obs in observations.items():
            own = staged(obs.select("client_id", "label", "t", "score"), "event-observations")
            if not own.isEmpty():
                found = {n: staged(t, f"event-{n}") for n, t in event_tables(own.withColumn("threshold", F.lit(0.0)), budgets, steps, per_hour).items()}
                if not found["metrics"].isEmpty():
                    tables[seed] = found
        if not tables:
            return "EMPTY"
        persist_tables(spark, path, tables)
        return "WRITTEN"
