"""What the text operators share: tables, staged results, words, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetward.staging import new_path, released, remove, written
from fleetward.staging import shared_folder as shared_dir

__all__ = ["new_path", "released", "remove", "shared_dir", "written"]

#: White space that separates words: space, and tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
#: A side of a join is broadcast up to so many bytes, counted before the join is planned.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, what: str, few: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, and no executor's loss takes it away.

    few: df may have far fewer rows than what it was made of, so Spark is asked for partitions, and files, of its
    advisory size; it is computed at full width before that. The table stays until released().
    """
    path = new_path(df.sparkSession, what)
    written(df.hint("rebalance") if few else df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a staged table) with a broadcast hint if its rows fit the limit; else Spark's own choice, a shuffle join.

    row_bytes: a row's size in memory; a column where rows differ, which is summed.
    """
    size = F.sum(row_bytes) if isinstance(row_bytes, Column) else F.count("*") * row_bytes
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= limit else df


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns of docs, and all of them as one, row: so no name of docs clashes with one of the operators."""
    return docs.select(*(F.col(c) for c in columns), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, unchanged."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t\\n\\x0B\\f\\r]+"))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id's text leaves no rest by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
