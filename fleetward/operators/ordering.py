"""Numbers by a total order, and digests that follow it, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetward.staging import staged

#: Children of a node of a hash tree.
FANOUT = 1024


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "nr") -> DataFrame:
    """df with name: 0 for a group's first row, and so on, in ascending order (null first); rows alike in order come in any.

    Rows are dealt out by ranges of keys and order and numbered where they lie; what a group has in each range, one
    row each, gives the range its first number. A group of any size is spread over its ranges.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = staged(dealt.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "numbered")
    parts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__least"))
    upto = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    same = F.lit(True)
    for k in [*keys, "__part"]:
        same = same & rows[k].eqNullSafe(parts[k])
    out = rows.join(parts, same).drop(*(parts[k] for k in [*keys, "__part"]))
    return out.select(*df.columns, (F.col("__before") + F.col("__id") - F.col("__least")).cast("long").alias(name))


def length_prefixed(parts: list[Column]) -> Column:
    """Texts as bytes, each behind its length in eight bytes, the greatest first; null is eight bytes of ones."""
    one = lambda x: F.coalesce(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(x).cast("long")), 16, "0")), F.encode(x, "UTF-8")), F.unhex(F.lit("f" * 16)))
    return F.concat(*(one(p) for p in parts))


def text_digest(parts: list[Column]) -> Column:
    """Lowercase SHA-256 of length-prefixed texts."""
    return F.sha2(length_prefixed(parts), 256)


def ordered_digest(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, n, digest): a hash tree over each group's rows in order.

    A row's digest is text_digest() of its cells as text. Up to fanout digests, in order, are hashed together to one,
    level by level until one is left; the group's digest is that of n (eight bytes) and the last one. order must be
    total but for rows that are alike in columns. The result does not depend on how rows are dealt out.
    """
    cells = [F.col(c).cast("string") for c in columns]
    rows = numbered(df.select(*keys, *(F.col(o).alias(f"__o{k}") for k, o in enumerate(order)), F.unhex(text_digest(cells)).alias("__h")), keys, [f"__o{k}" for k in range(len(order))], "__nr")
    nodes = rows.select(*keys, F.col("__nr"), "__h", F.lit(1).cast("long").alias("__w"))
    first = True
    while True:
        top = F.floor(F.col("__nr") / fanout).cast("long").alias("__nr2")
        listed = F.array_sort(F.collect_list(F.struct("__nr", "__h")))
        together = F.unhex(F.sha2(F.aggregate(listed, F.lit("").cast("binary"), lambda a, x: F.concat(a, x["__h"])), 256))
        # A group that has come down to one node stays as it is.
        folded = nodes.groupBy(*keys, top).agg(together.alias("__t"), F.max("__h").alias("__one"), F.count("*").alias("__c"), F.sum("__w").alias("__w"))
        alone = F.lit(False) if first else (F.col("__c") == 1) & (F.col("__nr2") == 0)
        nodes = staged(folded.select(*keys, F.col("__nr2").alias("__nr"), F.when(alone, F.col("__one")).otherwise(F.col("__t")).alias("__h"), "__w"), "digests")
        first = False
        if not nodes.where(F.col("__nr") > 0).limit(1).count():
            break
    whole = F.concat(F.unhex(F.lpad(F.hex(F.col("__w")), 16, "0")), F.col("__h"))
    return nodes.select(*keys, F.col("__w").alias("n"), F.sha2(whole, 256).alias("digest"))
