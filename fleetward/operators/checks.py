"""Invariants as DataFrames of their violations: no rows, no violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.join(right, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, keys, "left_anti").withColumn("side", F.lit("right")))


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null, NaN or infinity in some column."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.where(bad)


def completion(expected: DataFrame, present: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """expected keys with state: MISSING where nothing is present, VALID where ok holds (a column of present), else MALFORMED."""
    have = present.select(*keys, F.coalesce(ok, F.lit(False)).alias("__ok"))
    out = expected.join(have, keys, "left")
    return out.select(*keys, F.when(F.col("__ok").isNull(), "MISSING").when(F.col("__ok"), "VALID").otherwise("MALFORMED").alias("state"))


def progress(cells: DataFrame) -> DataFrame:
    """One row: cells by state, and the state of the whole."""
    n = lambda s: F.count_if(F.col("state") == s)
    out = cells.agg(F.count("*").alias("cells"), n("VALID").alias("valid"), n("MISSING").alias("missing"), n("MALFORMED").alias("malformed"))
    state = F.when(F.col("missing") == F.col("cells"), "NOT_STARTED").when(F.col("malformed") > 0, "FAILED").when(F.col("missing") > 0, "EXECUTION_INCOMPLETE").otherwise("PASSED")
    return out.withColumn("state", state)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or an error that names a key that more than one row has."""
    found = repeated(df, keys).first()
    if found:
        raise ValueError(f"{found['n']} rows have the key {[found[k] for k in keys]} of {keys}")
    return df


def require_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """An error that names a key that only one side has."""
    found = unmatched(a, b, keys).first()
    if found:
        raise ValueError(f"only the {found['side']} side has {[found[k] for k in keys]} of {keys}")


def covering(rows: DataFrame, reference: DataFrame, keys: list[str], by: list[str], what: str) -> DataFrame:
    """rows with reference's other columns by keys; an error, where it is read, if some of by has a key that reference lacks or lacks one that it has.

    reference is a small table, one row a key. Nothing is run before the result is.
    """
    everyone = Window.partitionBy(F.lit(1))
    named = reference.withColumns({"__all": F.count("*").over(everyone), "__known": F.lit(True)})
    out = rows.join(named, keys, "left")
    out = out.withColumn("__have", F.size(F.collect_set(F.struct(*keys)).over(Window.partitionBy(*(by or [F.lit(1)])))))
    text = lambda cols: F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols))
    strange = F.raise_error(F.concat(F.lit(f"{what}: no "), text(keys), F.lit(" in the reference"))).cast("boolean")
    short = F.raise_error(F.concat(F.lit(f"{what}: not all of the reference in "), text(by) if by else F.lit("the table"))).cast("boolean")
    fits = F.when(F.col("__known").isNull(), strange).when(F.col("__have") < F.col("__all"), short).otherwise(True)
    return out.where(fits).drop("__all", "__known", "__have")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def ladder(cells: DataFrame) -> DataFrame:
    """One row: the state of an experiment of cells in the states VALID, MISSING, MALFORMED, INCOMPLETE and STALE.

    NOT_STARTED if all are missing; else, the first that applies of EXECUTION_INCOMPLETE (missing ones), FAILED
    (malformed ones), EVIDENCE_INCOMPLETE (incomplete ones), STALE; PASSED if all are valid.
    """
    n = lambda s: F.count_if(F.col("state") == s)
    names = ["VALID", "MISSING", "MALFORMED", "INCOMPLETE", "STALE"]
    out = cells.agg(F.count("*").alias("cells"), *(n(s).alias(s.lower()) for s in names))
    state = F.when(F.col("missing") == F.col("cells"), "NOT_STARTED").when(F.col("missing") > 0, "EXECUTION_INCOMPLETE").when(F.col("malformed") > 0, "FAILED")
    return out.withColumn("state", state.when(F.col("incomplete") > 0, "EVIDENCE_INCOMPLETE").when(F.col("stale") > 0, "STALE").otherwise("PASSED"))


def digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free digest of rows within keys: their count, and the sum of 60 bits of each row's MD5.

    Repeated rows add up, where an exclusive or would cancel them. Cells are joined by their lengths and texts, so no
    two rows read alike; null differs from the empty text.
    """
    cell = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *map(cell, columns)).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("digest"))
