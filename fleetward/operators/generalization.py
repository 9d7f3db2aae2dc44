"""Attacks that were not validated on: rotations of subtype folds, and transfer between families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of a direction to the subtypes that are validated on, and those that are tested.
Directions = dict[str, tuple[list[str], list[str]]]


def rotations(folds: dict[str, list[str]]) -> Directions:
    """Each fold in turn is validated on and the others are tested; subtypes of two folds are an error."""
    every = [s for own in folds.values() for s in own]
    if len(set(every)) < len(every) or len(folds) < 2 or not all(folds.values()):
        raise ValueError("folds must be two or more, not empty, and share no subtype")
    return {name: (list(own), [s for other, x in folds.items() if other != name for s in x]) for name, own in folds.items()}


def transfers(one: list[str], other: list[str], names: tuple[str, str]) -> Directions:
    """From one family to the other, and back."""
    return {f"{names[0]} to {names[1]}": (list(one), list(other)), f"{names[1]} to {names[0]}": (list(other), list(one))}


def views(scores: DataFrame, directions: Directions, name: str = "direction") -> DataFrame:
    """scores once for each direction that it has a part in: benign rows in all, attack rows where their subtype is on their side."""
    texts = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    table = F.array(*(F.struct(F.lit(k).alias("name"), texts(v).alias("validation"), texts(t).alias("test")) for k, (v, t) in directions.items()))

    def stays(d: Column) -> Column:
        mine = F.col("attack_subtype")
        return F.when(F.col("split") == "attack_validation", F.array_contains(d["validation"], mine)).when(F.col("split") == "attack_test", F.array_contains(d["test"], mine)).otherwise(True)

    kept = F.transform(F.filter(table, lambda d: F.coalesce(stays(d), F.lit(False))), lambda d: d["name"])
    return scores.select("*", F.explode(kept).alias(name))


def run(scores: DataFrame, weights: DataFrame, directions: Directions, budgets: dict[str, float], **settings) -> dict[str, DataFrame]:
    """run_tables() of all policies for every direction, seed and budget, in one run: each table has the column direction.

    A direction and seed make a seed of their own.
    """
    from fleetward.operators.policies import run_tables

    kind = dict(scores.dtypes)["seed"]
    both = views(scores, directions)
    order = list(directions)
    number = F.array_position(F.array(*map(F.lit, order)), F.col("direction")) - 1
    both = both.withColumn("seed", F.concat(number.cast("string"), F.lit(":"), F.col("seed").cast("string"))).drop("direction")
    apart = F.split("seed", ":", 2)
    named = lambda df: df.withColumns({"direction": F.get(F.array(*map(F.lit, order)), apart[0].cast("int")), "seed": apart[1].cast(kind)})
    return {k: named(df) for k, df in run_tables(both, weights, budgets, **settings).items()}
