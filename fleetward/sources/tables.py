"""Score tables at rest: Parquet by data set, seed, device and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITIONS = ["dataset_id", "seed", "client_id", "split"]
SCORES = T.StructType(
    [
        T.StructField("sample_id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("source_row", T.LongType()), T.StructField("score", T.DoubleType()),
        T.StructField("label", T.StringType()), T.StructField("attack_subtype", T.StringType()), T.StructField("timestamp", T.DoubleType()),
        T.StructField("dataset_id", T.StringType()), T.StructField("seed", T.LongType()), T.StructField("client_id", T.StringType()), T.StructField("split", T.StringType()),
    ]
)


def write_scores(scores: DataFrame, path: str) -> None:
    """Overwrites the partitions that scores has; rows go to one task a partition and source file first, so files are few."""
    out = scores.select(*(F.col(f.name).cast(f.dataType) for f in SCORES))
    out.repartition(*PARTITIONS, "source_file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def read_scores(spark: SparkSession, path: str, columns: list[str] | None = None, **where: object) -> DataFrame:
    """Scores with predicates on columns (a value or a list); partition columns prune files, the others are pushed down."""
    out = spark.read.schema(SCORES).parquet(path)
    for name, value in where.items():
        out = out.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return out.select(*columns) if columns else out


def sample_id(client: str = "client_id", split: str = "split", subtype: str = "attack_subtype", row: str = "source_row"):
    """client|split[|subtype]|row"""
    return F.concat_ws("|", client, split, subtype, F.col(row).cast("string"))


def write_rows(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes a table that has rows; an empty one is an error."""
    from fleetward.operators.checks import require_rows

    out = require_rows(df, path).write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A report table as one CSV file with a header, in the order of its rows; report tables are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scaler(stats: DataFrame, path: str) -> None:
    """(client_id, feature, mean, sd) of each device."""
    write_rows(stats.select("client_id", "feature", "mean", "sd"), path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("client_id string, feature int, mean double, sd double").parquet(path)


def seed_bundle(spark: SparkSession, path: str, dataset: str, seed: int, population: DataFrame, train: bool = False) -> DataFrame:
    """All splits of one seed's scores (without training rows, or with them) for exactly the population's clients.

    A sample id of two rows, a client of the population without rows, or one outside it, is an error.
    """
    from fleetward.operators.checks import require_same_keys, require_unique

    splits = ["benign_frontier", "benign_final_cal", "benign_test", "attack_validation", "attack_test", *["benign_train"] * train]
    out = read_scores(spark, path, dataset_id=dataset, seed=seed, split=splits)
    require_same_keys(out, population, ["client_id"])
    return require_unique(out, ["sample_id"])


def persist_run(results: DataFrame, evaluations: DataFrame, allocations: DataFrame, path: str) -> None:
    """A run's tables below path, one commit for each seed and budget: a cell has all of its tables or none.

    Only what has rows is written; a cell that is there already is replaced.
    """
    from fleetward.sources.commits import commit

    spark = results.sparkSession
    whole = {"results": results, "evaluations": evaluations, "allocations": allocations}
    rows = {n: df.groupBy("seed", "budget_id").count().collect() for n, df in whole.items()}
    cells = sorted({(r["seed"], r["budget_id"]) for x in rows.values() for r in x})
    for seed, budget in cells:
        here = [n for n, x in rows.items() if any((r["seed"], r["budget_id"]) == (seed, budget) for r in x)]
        commit(spark, f"{path}/seed={seed}/budget_id={budget}", {n: whole[n].where((F.col("seed") == seed) & (F.col("budget_id") == budget)) for n in here})


def read_run(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of all committed cells of a run; an error if no cell has it."""
    from fleetward.sources.commits import current

    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/seed=*/budget_id=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    out = None
    for x in found or []:
        one = current(spark, x.getPath().toString()).get(name)
        out = one if out is None else out if one is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no {name} below {path}")
    return out


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Evaluations in the order of seed, budget and policy; cells that were never written are not there."""
    return read_run(spark, path, "evaluations").orderBy("seed", "budget_id", "policy")


def score_records(scores: DataFrame, dataset: str, seed: int) -> DataFrame:
    """Records of scored rows (client_id, split, label, attack_subtype, ordinal, score, timestamp): SCORES.

    source_row counts from 0 within client, split and subtype, in the order of the rows' ordinals.
    """
    from fleetward.operators.ranking import positions

    out = positions(scores, ["client_id", "split", "attack_subtype"], "ordinal").withColumn("source_row", F.col("position") - 1)
    out = out.withColumns({"dataset_id": F.lit(dataset), "seed": F.lit(seed).cast("long"), "source_file": F.concat_ws("/", "client_id", "split")})
    if "timestamp" not in out.columns:
        out = out.withColumn("timestamp", F.lit(None).cast("double"))
    return out.withColumn("sample_id", sample_id()).select(*(F.col(f.name).cast(f.dataType) for f in SCORES))
