"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Every expression is a built-in Spark function. A document is contaminated by an item of n
words if some window of n words has at least SIMILARITY of weighted 5-word shingles in common
with it (shingles weigh as often as they occur: sum of minima over sum of maxima).

1. Only shingles that occur in some item can be shared, so a window is made of those alone:
   positions of known shingles ("hits") are kept, with nothing said about which item they
   belong to. A window below the share of hits that the similarity needs cannot reach it.
2. Hits of a document fall into stretches; equal stretches, from whatever documents, are
   worked on once, so copies and popular passages cost one.
3. Each window of a stretch, for each length that items have, gets a 64-bit SimHash of its
   hits. Eight blocks of eight bits, each looked up with all its one-bit neighbours, find
   every item fingerprint of that length within Hamming distance 15.
4. Pairs found are decided by the exact weighted similarity.
5. Items of fewer than five words have no shingle; a window holds one if its words are the item's.

The blocks guarantee every fingerprint within the radius; SimHash itself is a sketch. At
similarity 0.8 a window and its item differ in 7 to 10 bits of 64, and those of the
faintest pairs that differ in more than 15 are lost: see the README for measured shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import small_side, stage, text_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 8
BITS = 8
_P = "__dc_"


def _shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text; words are runs of letters and digits in lower case."""
    bare = F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _hashes(words: Column) -> Column:
    head = F.slice(words, 1, F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))
    return F.transform(head, lambda x, i: F.xxhash64(x, *(F.get(words, i + j) for j in range(1, SHINGLE))))


def _fingerprint(hashes: Column) -> Column:
    """64-bit SimHash: a bit is set where more than half of the hashes, each as often as it occurs, have it."""
    bit = lambda i: F.when(2 * F.size(F.filter(hashes, lambda h: F.getbit(h, i) == 1)) > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _block(fingerprint: Column, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, b * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, g, fp): shingle count, hashes and fingerprint of items of five words or more."""
    out = benchmark.select("item_id", _shingles(text_of()).alias("w")).select("item_id", _hashes(F.col("w")).alias("g"))
    out = out.where(F.size("g") > 0).select("item_id", F.size("g").alias("n"), "g")
    return out.withColumn("fp", _fingerprint(F.col("g")))


def _short_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """(doc_id, item_id, similarity, start, n_words) of items of one to four words; None if there are none."""
    items = benchmark.select("item_id", _shingles(text_of()).alias("w")).where(F.size("w").between(1, SHINGLE - 1)).select("item_id", F.size("w").alias("k"), F.array_join("w", " ").alias("x"))
    items = stage(items.distinct(), "decontaminate-short", few=True)
    sizes = [r["k"] for r in items.select("k").distinct().collect()]
    if not sizes:
        return None
    words = docs.select("doc_id", _shingles(text_of()).alias("w"))
    gram = lambda k: F.transform(F.slice("w", 1, F.greatest(F.size("w") - (k - 1), F.lit(0))), lambda x, i: F.array_join(F.slice("w", i + 1, k), " "))
    grams = [words.select("doc_id", F.lit(k).alias("k"), F.posexplode_outer(gram(k)).alias("at", "x")).where(F.col("x").isNotNull()) for k in sizes]
    every = grams[0]
    for more in grams[1:]:
        every = every.unionByName(more)
    found = every.join(small_side(items, 96 + F.octet_length("x")), ["k", "x"]).groupBy("doc_id", "item_id", "k").agg(F.min("at").alias("at"))
    return found.select("doc_id", "item_id", F.lit(1.0).alias("similarity"), F.col("at").alias("start"), F.col("k").alias("n_words"))


def _need(n: int, similarity: float) -> int:
    """Hits that a window of at most n shingles must have: |A and B| >= s |A or B| >= s n."""
    return max(1, -int(-similarity * n + 1e-9))


def _stretches(docs: DataFrame, items: DataFrame, similarity: float) -> tuple[DataFrame, list[int]]:
    """(doc_id, h, first, tail, content, ck): stretches of hits, and the shingle counts that items have."""
    p, col = _P, F.col
    # One number for each length that occurs: no more than the longest item has words.
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())
    longest = sizes[-1] if sizes else 1
    known = small_side(stage(items.select(F.explode("g").alias("x")).distinct(), "decontaminate-known", few=True), 40)
    words = docs.select("doc_id", text_of().alias("t")).select("doc_id", F.xxhash64("t").alias("h"), _shingles(col("t")).alias("w"))
    hashed = words.select("doc_id", "h", _hashes(col("w")).alias("g"))
    # The outer form: the inner one would have Spark filter on the array's size, below the projections that build it.
    hits = hashed.select("doc_id", "h", F.size("g").alias("m"), F.posexplode_outer("g").alias("at", "x")).join(known, "x")
    per = hits.groupBy("doc_id", "h", "m").agg(F.array_sort(F.collect_set(F.struct("at", "x"))).alias("hits"))
    gap = longest - _need(longest, similarity) + 1
    starts = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda i: (i == 0) | (F.get("hits", i)["at"] - F.get("hits", i - 1)["at"] > gap))
    per = per.withColumn("starts", starts).select("doc_id", "h", "m", "hits", "starts", F.posexplode("starts").alias("k", "from"))
    upto = F.coalesce(F.get("starts", col("k") + 1), F.size("hits"))
    per = per.select("doc_id", "h", "m", F.slice("hits", col("from") + 1, upto - col("from")).alias("part"))
    first = F.get("part", F.lit(0))["at"]
    per = per.where(F.size("part") >= _need(sizes[0] if sizes else 1, similarity)).select(
        "doc_id", first.alias("first"), F.transform("part", lambda x: F.struct((x["at"] - first).alias("o"), x["x"].alias("x"))).alias("content"),
        # Shingles from the first hit to the text's end; beyond the reach of any window the number doesn't matter.
        F.least(col("m") - first, F.element_at("part", -1)["at"] - first + 1 + longest).alias("tail"),
    )
    key = F.md5(F.concat_ws(";", F.array_join(F.transform("content", lambda x: F.concat_ws(":", x["o"].cast("string"), x["x"].cast("string"))), ","), col("tail").cast("string")).cast("binary"))
    return per.withColumn("ck", key), sizes


def _windows(content: DataFrame, sizes: list[int], similarity: float) -> DataFrame:
    """(ck, n, o, real, g, fp): windows that have enough hits, with their shingles in all (real) and their hits (g)."""
    col = F.col
    options = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(_need(n, similarity)).alias("need")) for n in sizes)) if sizes else F.array().cast("array<struct<n:int,need:int>>")
    fit = F.filter(options, lambda x: x["need"] <= F.size("content"))
    out = content.select("ck", "tail", "content", F.inline(fit))
    at = F.filter(F.sequence(F.lit(0), F.size("content") - col("need")), lambda i: F.get("content", i + col("need") - 1)["o"] - F.get("content", i)["o"] < col("n"))
    out = out.select("ck", "tail", "content", "n", F.explode(at).alias("i"))
    o = F.get("content", col("i"))["o"]
    inside = F.filter(F.slice("content", col("i") + 1, col("n")), lambda x: x["o"] < o + col("n"))
    out = out.select("ck", "n", o.alias("o"), F.least(col("n"), col("tail") - o).alias("real"), F.transform(inside, lambda x: x["x"]).alias("g"))
    return out.withColumn("fp", _fingerprint(col("g")))


def _common(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller number of occurrences."""
    times = lambda xs, h: F.size(F.filter(xs, lambda y: y == h))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h)))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): each item that a document contains, with its best window.

    start and n_words count the normalised words (runs of letters and digits). Null and empty texts hold nothing, and
    nothing holds an item without words; items of fewer than five words are held whole or not at all; repeated rows of a document give one row for each item; copies
    under other ids give rows of their own; a null doc_id is a value like others; empty tables give no rows. Other
    columns are left out.
    """
    p, col = _P, F.col
    items = stage(items_of(benchmark.select("item_id", "text")), "decontaminate-items", few=True)
    stretches, sizes = _stretches(docs.select("doc_id", "text"), items, similarity)
    stretches = stage(stretches, "decontaminate-stretches", few=True)
    # Few rows, much work for each: dealt out in full, where Spark would put them into one task by their size.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contents = stretches.dropDuplicates(["ck"]).repartition(parts)
    windows = stage(_windows(contents, sizes, similarity), "decontaminate-windows", few=True)
    block_of = lambda b, fp: F.struct(F.lit(b).alias("b"), _block(fp, b).alias("v"))
    probes = windows.select("ck", "n", "o", "fp", F.inline(F.array(*(block_of(b, col("fp")) for b in range(BLOCKS)))))
    flips = [0, *(1 << i for i in range(BITS))]
    index = items.select("item_id", "n", col("fp").alias("item_fp"), F.inline(F.array(*(block_of(b, col("fp")) for b in range(BLOCKS)))))
    index = index.select("item_id", "n", "item_fp", "b", F.explode(F.array(*(col("v").bitwiseXOR(F.lit(f)) for f in flips))).alias("v"))
    near = probes.join(index, ["n", "b", "v"]).where(F.bit_count(col("fp").bitwiseXOR(col("item_fp"))) <= RADIUS)
    near = near.select("ck", "n", "o", "item_id").distinct()
    found = near.join(windows.select("ck", "n", "o", "real", "g"), ["ck", "n", "o"]).join(items.select("item_id", col("g").alias("item_g")).dropDuplicates(["item_id", "item_g"]), "item_id")
    both = _common(col("g"), col("item_g"))
    found = found.withColumn(p + "both", both).withColumn("similarity", col(p + "both") / (col("real") + F.size("item_g") - col(p + "both")))
    found = found.where((col("similarity") >= similarity - 1e-12) & (F.size("item_g") == col("n")))
    best = found.groupBy("ck", "item_id").agg(F.max(F.struct("similarity", (-col("o")).alias("o"), "n")).alias("best"))
    best = small_side(stage(best, "decontaminate-found", few=True), 128)
    out = stretches.select("doc_id", "first", "ck").join(best, "ck")
    out = out.select("doc_id", "item_id", F.struct(col("best.similarity").alias("similarity"), (col("best.o") - col("first")).alias("o"), col("best.n").alias("n")).alias("best"))
    out = out.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    out = out.select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), (-col("best.o")).alias("start"), (col("best.n") + SHINGLE - 1).alias("n_words"))
    short = _short_matches(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return out if short is None else out.unionByName(short)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose document holds no benchmark item, with the columns of docs, whatever their names.

    Null and empty texts stay; null ids go together, and so do repeated rows; empty tables leave docs as they are.
    """
    bad = small_side(stage(matches(docs, benchmark, similarity).select(F.col("doc_id").alias(_P + "id")).distinct(), "decontaminate-ids", few=True), 24)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[_P + "id"]), "left_anti")
