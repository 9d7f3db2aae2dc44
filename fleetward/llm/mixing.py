"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in the mix rate = target / source size times.
Documents stand in a fixed order within their source; their expected copies are summed
along it, one offset is added, and a document is emitted once for each integer that the
running sum crosses. The running sum is rate x rank, and the rank comes in two steps, so
that no source passes through one task: counts by (source, size class, lane) give each
such cell its first rank, and rows are numbered within their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetward.llm.common import packed, stage, text_of, words_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix-1"


def _cells(rows: DataFrame) -> DataFrame:
    """Adds to rows of doc_id, text and source: size, the source's key and the cell of each row (class, lane).

    The lane, one of 256, comes from a hash of the id, or of the text where the id is null, so neither ids with a
    step nor many null ids meet in one.
    """
    out = rows.withColumn("size", F.size(words_of(text_of())).cast("long"))
    bits = F.bin("size")
    # The length in bits and the three bits after the first: classes an eighth of an octave wide.
    cls = (F.length(bits) * 8 + F.when(F.length(bits) > 3, F.conv(F.substring(bits, 2, 3), 2, 10).cast("int")).otherwise(0)).cast("int")
    lane = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), text_of()).cast("binary")), 1, 2)
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    return out.withColumns({"key": key, "class": cls, "lane": lane}).drop("text", "source")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(key, source_size) to (key, source_size, target, offset): one row a source.

    Keys by code point ('-', the null source, sorts behind '+...') take the weights in turn. Each source gets
    its weight's share of all sizes, at most cap x its own size; what is above goes to the others by weight.
    Sources in the order of cap x size / weight: one is full if what the fuller ones leave gives it that much.
    Sources take their turns in one order, so one task sorts the table of one row a source.
    """
    turn = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    out = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    ratio = F.col("source_size") * cap / F.col("w")
    before = Window.orderBy(ratio, "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    out = out.withColumn("full", left.cast("double") / weight >= ratio).withColumn("total", total)
    open_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(everything)
    level = (F.col("total") - F.sum(F.when(F.col("full"), F.col("source_size") * cap).otherwise(0)).over(everything)).cast("double") / F.when(open_w > 0, open_w)
    return out.select(
        "key", "source_size",
        F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(level * F.col("w")).alias("target"),
        (F.conv(F.substring(F.md5(F.concat(F.col("key"), F.lit(SEED)).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("offset"),
    )


def _sampled(rows: DataFrame, cells: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """rows (with their cells) with source_size, target and copies; cells: the same rows, to be counted."""
    col = F.col
    counts = cells.groupBy("key", "class", "lane").agg(F.count("*").alias("n"), F.sum("size").alias("sum"))
    sizes = counts.groupBy("key").agg(F.sum("sum").alias("source_size"))
    goal = targets(sizes, weights, cap)
    upto = Window.partitionBy("key").orderBy("class", "lane").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("key", "class", "lane", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")).join(goal, "key")
    inside = Window.partitionBy("key", "class", "lane").orderBy("size", F.col("doc_id").asc_nulls_first())
    out = rows.join(first, ["key", "class", "lane"]).withColumn("rank", col("before") + F.row_number().over(inside))
    rate = F.when(col("source_size") > 0, col("target") / col("source_size")).otherwise(0.0)
    crossed = lambda r: F.floor(col("offset") + rate * r)
    copies: Column = F.least(crossed(col("rank")) - crossed(col("rank") - 1), F.lit(cap)).cast("long")
    return out.withColumn("copies", copies)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (its words in the mix), copies.

    Null text has size 0 and takes 0 words; the null source is one source; repeated rows count each. The order
    within a source is by size class, lane of the id, size and id, so reruns agree; rows equal in all of these
    may exchange their copies. An empty table gives no rows. Other columns of docs are left out.
    """
    rows = stage(_cells(docs.select("doc_id", "text", "source")), "mix-sizes")
    out = _sampled(rows, rows, weights, cap)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs and copy (1, 2, ...).

    A column of docs named copy gives way to the copy's number; other columns stay, whatever their names. Null
    texts, null ids, null sources and repeated rows are as in plan_mix; an empty table stays empty.
    """
    rows = _cells(packed(docs, "doc_id", "text", "source"))
    out = _sampled(rows, _cells(docs.select("doc_id", "text", "source")), weights, cap).where(F.col("copies") > 0)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "copy"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


#: The same mix in DuckDB's SQL.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS key,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 2) AS lane,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS size
  FROM documents),
c AS (
  SELECT *, length(bin(size)) * 8 + CASE WHEN length(bin(size)) > 3
    THEN CAST((size >> CAST(length(bin(size)) - 4 AS BIGINT)) & 7 AS BIGINT) ELSE 0 END AS cls
  FROM d),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY key),
w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w FROM s),
r AS (SELECT *, source_size * {MAX_COPIES} / CAST(w AS DOUBLE) AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
f AS (
  SELECT *, CAST(total - coalesce(sum(source_size * {MAX_COPIES}) OVER b, 0) AS DOUBLE)
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) >= ratio AS is_full
  FROM r WINDOW b AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT key, source_size, CASE WHEN is_full THEN CAST(source_size * {MAX_COPIES} AS DOUBLE) ELSE
      CAST(total - sum(CASE WHEN is_full THEN source_size * {MAX_COPIES} ELSE 0 END) OVER () AS DOUBLE)
      / nullif(CAST(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS DOUBLE), 0) * w END AS target,
    list_sum(list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', substr(md5(key || '{SEED}'), i, 1)) - 1 AS DOUBLE) * pow(16, 8 - i))) / 4294967296.0::DOUBLE AS off
  FROM f),
o AS (
  SELECT c.doc_id, c.size, g.source_size, g.target, g.off,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY c.key ORDER BY c.cls, c.lane, c.size, c.doc_id NULLS FIRST) AS rank
  FROM c JOIN g USING (key)),
n AS (
  SELECT *, least(CAST(floor(off + rate * rank) - floor(off + rate * (rank - 1)) AS BIGINT), {MAX_COPIES}) AS copies FROM o)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM n
"""
