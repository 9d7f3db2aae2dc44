"""Deterministic splits of each device's rows by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.operators.ranking import positions

BENIGN = ("benign_train", "benign_frontier", "benign_final_cal", "benign_test")
BENIGN_BOUNDS = (0.5, 0.7, 0.8)
ATTACK_FRACTION = 0.2


def _bound(fraction: float, n: Column) -> Column:
    """floor(fraction x n) in IEEE doubles."""
    return F.floor(F.lit(float(fraction)) * n.cast("double"))


def split_rows(obs: DataFrame, bounds: tuple[float, float, float] = BENIGN_BOUNDS, attack: float = ATTACK_FRACTION, keys: tuple[str, ...] = ("client_id",)) -> DataFrame:
    """Adds split: benign rows by position within the device, attack rows by position within device and subtype."""
    out = positions(obs, [*keys, "label", "attack_subtype"], "ordinal")
    ix, n = F.col("position") - 1, F.col("n")
    benign = F.when(ix < _bound(bounds[0], n), BENIGN[0]).when(ix < _bound(bounds[1], n), BENIGN[1]).when(ix < _bound(bounds[2], n), BENIGN[2]).otherwise(BENIGN[3])
    hostile = F.when(ix < _bound(attack, n), "attack_validation").otherwise("attack_test")
    return out.withColumn("split", F.when(F.col("label") == "benign", benign).otherwise(hostile)).drop("position", "n")


def restrict_subtypes(scores: DataFrame, validation: list[str], test: list[str]) -> DataFrame:
    """Attack rows of the given subtypes on each side; benign rows as they are."""
    keep = F.when(F.col("split") == "attack_validation", F.col("attack_subtype").isin(validation)).when(F.col("split") == "attack_test", F.col("attack_subtype").isin(test)).otherwise(True)
    return scores.where(keep)


def oracle_view(scores: DataFrame) -> DataFrame:
    """The attack test rows stand in for the validation rows too."""
    test = scores.where(F.col("split") == "attack_test")
    return scores.where(F.col("split") != "attack_validation").unionByName(test.withColumn("split", F.lit("attack_validation")))
