"""What has been computed from what: states of cells, and runs that redo only what has changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetward.operators.ordering import ordered_digest
from fleetward.sources import commits
from fleetward.staging import released, staged

#: From the worst to the best: the first that holds is a cell's state.
STATES = ("MISSING", "INCOMPLETE", "STALE", "MALFORMED", "VALID")


def cell_states(expected: DataFrame, stored: DataFrame, keys: list[str], main: str, parts: list[str]) -> DataFrame:
    """(keys, state) of expected cells (keys, digest): what their outputs should have been made of.

    stored: keys, part, digest, ok; a row for each output of a cell, with the digest of what it was made of and
    whether it reads well. MISSING: the main part is not there. INCOMPLETE: another part is not. STALE: a part was
    made of something else. MALFORMED: a part does not read well. A part of two rows is no better than its worse.
    """
    wanted = [main, *parts]
    have = stored.where(F.col("part").isin(wanted)).select(*keys, "part", F.col("digest").alias("__d"), F.coalesce("ok", F.lit(False)).alias("__ok"))
    same = F.lit(True)
    for k in keys:
        same = same & expected[k].eqNullSafe(have[k])
    out = expected.join(have, same, "left").drop(*(have[k] for k in keys)).groupBy(*keys).agg(
        F.count_if(F.col("part") == main).alias("__main"), F.count_distinct("part").alias("__parts"),
        F.max(F.col("part").isNotNull() & ~F.col("__d").eqNullSafe(F.col("digest"))).alias("__stale"), F.min("__ok").alias("__good"),
    )
    state = F.when(F.col("__main") == 0, "MISSING").when(F.col("__parts") < len(wanted), "INCOMPLETE").when(F.col("__stale"), "STALE").when(~F.col("__good"), "MALFORMED").otherwise("VALID")
    return out.select(*keys, state.alias("state"))


def reusable(expected: DataFrame, stored: DataFrame, keys: list[str], digests: list[str]) -> DataFrame:
    """Keys of expected whose stored digests (a trained model's, a score table's: several columns) all agree."""
    right = stored.select(*(F.col(c).alias(f"__{c}") for c in [*keys, *digests]))
    same = F.lit(True)
    for c in [*keys, *digests]:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return expected.join(right, same, "left_semi").select(*keys)


def _equal(a: DataFrame, b: DataFrame, columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def refresh(spark: SparkSession, path: str, inputs: DataFrame, keys: list[str], order: list[str], run: Callable[[DataFrame], DataFrame], version: str = "1") -> DataFrame:
    """Runs what inputs have that is new or changed by key, and commits it below path; the keys that were run.

    Each key's inputs have an ordered digest, in the order of the given columns, and version stands for the code and
    its parameters. Keys whose stored digest agrees keep their outputs where they are; run() gets the inputs of the
    others, and its result has the keys. Keys that inputs no longer have are forgotten. One commit holds the new
    outputs and a small table of keys, digests and the commit that each key's output lies in.
    """
    with released(spark):
        columns = [c for c in inputs.columns if c not in keys]
        now = ordered_digest(inputs, keys, order, columns).select(*keys, F.sha2(F.concat_ws(":", F.lit(version), "digest"), 256).alias("digest"))
        now = staged(now, "input-digests")
        found = commits.current(spark, path)
        number = (commits.mark(spark, path) or {"number": 0})["number"] + 1
        old = found["cells"] if found else now.select(*keys, "digest", F.lit(0).cast("long").alias("commit")).limit(0)
        before = old.select(*(F.col(c).alias(f"__{c}") for c in keys), F.col("digest").alias("__digest"), F.col("commit").alias("__commit"))
        same = F.col("digest") == F.col("__digest")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        cells = now.join(before, same, "left").select(*keys, "digest", F.coalesce("__commit", F.lit(number).cast("long")).alias("commit"))
        cells = staged(cells, "cells")
        todo = cells.where(F.col("commit") == number).select(*keys)
        if todo.isEmpty() and found and cells.count() == old.count():
            return spark.createDataFrame([], todo.schema)
        own = inputs.join(todo, _equal(inputs, todo, keys), "left_semi")
        commits.commit(spark, path, {"outputs": run(own), "cells": cells})
        return commits.current(spark, path)["cells"].where(F.col("commit") == number).select(*keys)


def outputs(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The outputs of all current keys, each from the commit that made it."""
    found = commits.current(spark, path)
    if not found:
        raise ValueError(f"nothing has been computed below {path}")
    out = None
    for r in found["cells"].select("commit").distinct().orderBy("commit").collect():
        rows, own = commits.current(spark, path, r["commit"])["outputs"], found["cells"].where(F.col("commit") == r["commit"]).select(*keys)
        one = rows.join(own, _equal(rows, own, keys), "left_semi")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else found["outputs"].limit(0)
