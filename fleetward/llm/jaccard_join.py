"""N-gram Jaccard join by chosen paths.

A document is its set of 5-word shingles; two are linked at similarity 0.8 or more.

1. Equal sets form a class, and only one set of each goes on: copies cost one. A set is sampled
   once: of its shingles in each of BINS bins the one of least hash, so two sets agree in a
   bin with probability equal to their similarity.
2. A run splits all sets by recursion: a node chooses one bin, and its sets go down by their
   sampled token there. A node of LEAF sets or fewer is searched; so is one that kept more than
   SIMILARITY of its parent's sets, since splitting would lose pairs there and gain nothing.
3. A pair at 0.8 stays together down to a leaf of depth d with probability 0.8 ** d. Runs are
   repeated, RUNS at a time, until that leaves each set a chance of 1 - RECALL or less to
   miss a partner.
4. Leaves are searched by brute force on a byte of each sampled token, which estimate the similarity;
   what is more than five standard deviations below 0.8 is left out. Leaves of more than BLOCK sets
   are dealt out as pairs of blocks. A pair counts only in the first run that holds it
   together. A task returns no pairs, only which sets have partners to verify.
5. Those alone meet their texts again, and their pairs are decided by whole shingle sets.
   Returned are each set's number of links and a spanning forest of them, whose components are
   the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import packed, small_side, stage, text_of
from fleetward.llm.graph import components
from fleetward.llm.tokens import mix, slices, window_hashes, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Runs that are added at a time, the recall to be reached, and the bins of a set's sample.
RUNS = 20
RECALL = 1 - 1e-6
BINS = 96
#: Sets of a node that is searched, sets of a block, and levels after which any node is searched.
LEAF = 256
BLOCK = 1024
DEEPEST = 12


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's k-word shingles; a text of fewer words has one shingle, all of them; an empty one none."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = word_hashes(data, *word_bounds(data))
    return np.unique(window_hashes(words, min(k, len(words)))) if len(words) else words


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The token of least hash in each of BINS bins; an empty bin takes the next filled one's, marked by the distance."""
    order = mix(tokens + np.uint64(0x51ED270B))
    bins = (order % np.uint64(BINS)).astype(np.int64)
    value = (order >> np.uint64(24)) & np.uint64(0xFFFFFFFF)
    out = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(out, bins, value)
    filled = np.flatnonzero(out != np.iinfo(np.uint64).max)
    ahead = np.searchsorted(filled, np.arange(BINS))
    source = filled[ahead % len(filled)]
    distance = (source - np.arange(BINS)) % BINS
    return ((out[source] + distance.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in slices(batches, 500):
        sets = [shingle_set(t) for t in b["text"]]
        s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
        s2 = np.array([mix(s ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
        marks = [sketch(s).view(np.int32) if len(s) else np.empty(0, dtype=np.int32) for s in sets]
        yield pd.DataFrame({"doc_id": b["doc_id"], "h1": b["h1"], "h2": b["h2"], "s1": s1, "s2": s2, "n": [len(s) for s in sets], "sk": marks, "bytes": [m.astype(np.uint8).tobytes() for m in marks]})


class Forest:
    """Which of n nodes hang together, taken in a node's links at a time: no list of links is kept."""

    def __init__(self, n: int) -> None:
        self.label, self.linked = np.arange(n), np.zeros(n, dtype=bool)

    def add(self, x: int, y: np.ndarray) -> None:
        if not len(y):
            return
        self.linked[x] = True
        self.linked[y] = True
        own = np.unique(np.r_[self.label[x], self.label[y]])
        if len(own) > 1:
            self.label[np.isin(self.label, own)] = own[0]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each linked node, and the least node that it hangs together with."""
        node = np.flatnonzero(self.linked)
        return node, self.label[node]


def _near(sk: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, same: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the pairs' sampled tokens (same: shares that agree) leave the similarity possible."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    seen = np.maximum(np.minimum(small, BINS) * 0.5, 1)
    return (small >= similarity * large - 1e-9) & (same >= similarity - 5 * np.sqrt(similarity * (1 - similarity) / seen))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], at_least: int) -> Iterator[pd.DataFrame]:
    """Rows ordered by keys, in frames of whole groups of about at_least rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= at_least:
            rows = pd.concat(held, ignore_index=True)
            cut = int(_borders(rows, keys)[-2])
            if cut:
                yield rows.iloc[:cut]
            held, n = [rows.iloc[cut:].reset_index(drop=True)], len(rows) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def _borders(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    key = rows[keys].to_numpy()
    return np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(rows)]


def _own_pairs(sk: np.ndarray, n: np.ndarray, leaves: np.ndarray, side: np.ndarray | None, leaf: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys): pairs of rows that may be similar and that this leaf, and no earlier run's, holds together.

    side: rows of two blocks, of which only pairs across are wanted.
    """
    m = len(sk)
    for x in range(m - 1):
        y = np.arange(x + 1, m)
        if side is not None:
            y = y[side[y] != side[x]]
        y = y[_near(sk, n, np.full(len(y), x), y, (sk[y] == sk[x]).mean(axis=1), similarity)]
        if len(y):
            both = (leaves[y] == leaves[x]) & (leaves[x] != 0)
            y = y[leaves[y, np.argmax(both, axis=1)] == leaf]
            if len(y):
                yield x, y


KEYS = ["id", "i", "j"]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, int]]:
    """Rows of one pair of blocks each, with their samples, sizes, leaves, sides and leaf."""
    for rows in _groups(batches, KEYS, 4096):
        at = _borders(rows, KEYS)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = rows.iloc[s:e]
            # A repeated row comes twice.
            own = own.drop_duplicates("c") if own["c"].duplicated().any() else own
            sk = np.frombuffer(b"".join(own["bytes"]), dtype=np.uint8).reshape(len(own), -1)
            leaves = np.array(own["leaves"].tolist()).reshape(len(own), -1)
            yield own, sk, own["n"].to_numpy(), leaves, own["block"].to_numpy() if own["i"].iat[0] != own["j"].iat[0] else None, int(own["id"].iat[0])


def _candidate_rows(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for rows, sk, size, leaves, side, leaf in _parts(batches):
            hit = np.zeros(len(rows), dtype=bool)
            for x, y in _own_pairs(sk, size, leaves, side, leaf, similarity):
                hit[x] = True
                hit[y] = True
            if hit.any():
                out.append(rows.loc[hit, [*KEYS, "block", "c"]])
                n += len(out[-1])
            if n >= 4096:
                yield pd.concat(out, ignore_index=True)
                out, n = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, by products of token-by-set matrices in slices of the tokens."""
    m = len(sets)
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, count = np.unique(token, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    code, owner = np.unique(code[keep], return_inverse=True)[1], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((m, m), dtype=np.float64)
    every = int(code[-1]) + 1 if len(code) else 0
    wide = max(1, min(every, (1 << 21) // m))
    for start in range(0, every, wide):
        a, b = np.searchsorted(code, [start, start + wide])
        part = np.zeros((m, wide), dtype=np.float32)
        part[owner[a:b], code[a:b] - start] = 1
        out += part @ part.T
    return out


def _exact_rows(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sk, size, leaves, side, leaf in _parts(batches):
            pairs = list(_own_pairs(sk, size, leaves, side, leaf, similarity))
            if not pairs:
                continue
            both = _overlaps([np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"]])
            links, found = np.zeros(len(rows), dtype=np.int64), Forest(len(rows))
            for x, y in pairs:
                y = y[both[x, y] >= similarity * (size[x] + size[y] - both[x, y]) - 1e-9]
                links[x] += len(y)
                links[y] += 1
                found.add(x, y)
            node, root = found.edges()
            if len(node):
                c = rows["c"].to_numpy()
                yield pd.DataFrame({"c": c[node], "root": c[root], "links": links[node]})

    return run


def _token_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in slices(batches, 500):
        yield b.drop(columns="text").assign(tokens=[shingle_set(t).tobytes() for t in b["text"]])


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """Adds block, i, j: each row once for each pair of blocks that its own is part of; one pair if the leaf is small."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("c", "id"), blocks).cast("int")
    out = rows.withColumn("blocks", blocks).withColumn("block", mine)
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def _split(classes: DataFrame, first: int, runs: int, similarity: float, leaf: int) -> DataFrame:
    """(c, run, id, size, depth): the leaf that each set comes to in each of some runs, by recursion of all at once."""
    col = F.col
    sets = classes.where(col("n") > 0).select("c", "sk")
    # Runs start at different bins.
    down = F.inline(F.array(*(F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), F.get("sk", F.lit(r % BINS))).alias("id")) for r in range(first, first + runs))))
    placed = sets.select("c", down).withColumn("parent", F.lit(sets.count()).cast("long"))
    out = []
    for depth in range(1, DEEPEST + 1):
        placed = stage(placed, "jaccard-placed")
        big = placed.groupBy("id").agg(F.count("*").alias("size"), F.any_value("parent").alias("parent")).where((col("size") > leaf) & (col("size") <= similarity * col("parent")))
        big = stage(big.select("id", "size"), "jaccard-big", few=True)
        if depth == DEEPEST or big.isEmpty():
            out.append(placed.withColumn("depth", F.lit(depth)))
            break
        side = small_side(big, 32)
        out.append(placed.join(side.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        bin_ = F.pmod(F.xxhash64(F.lit("bin"), "id"), F.lit(BINS)).cast("int")
        placed = placed.select("c", "run", "id").join(side, "id").join(sets, "c").select("c", "run", F.xxhash64("id", F.get("sk", bin_)).alias("id"), col("size").alias("parent"))
    every = out[0].select("c", "run", "id", "depth")
    for x in out[1:]:
        every = every.unionByName(x.select("c", "run", "id", "depth"))
    return stage(every, "jaccard-leaves")


def _leaves(classes: DataFrame, similarity: float, leaf: int) -> tuple[DataFrame, int]:
    """(c, run, id, depth) of as many runs as the recall needs, and their number."""
    out, runs = None, 0
    miss = F.sum(F.log1p(-F.pow(F.lit(similarity), "depth")))
    while True:
        new = _split(classes, runs, RUNS, similarity, leaf)
        out, runs = new if out is None else out.unionByName(new), runs + RUNS
        worst = out.groupBy("c").agg(miss.alias("miss")).agg(F.max("miss")).first()[0]
        if worst is None or worst <= math.log(1 - RECALL):
            return out, runs


def _links(docs: DataFrame, classes: DataFrame, similarity: float, leaf: int, block: int) -> DataFrame:
    """(c, root, links): a row for each set and pair of blocks that holds links of its own."""
    col = F.col
    leaves, runs = _leaves(classes, similarity, leaf)
    member = F.xxhash64("c")
    nodes = leaves.groupBy("id").agg(F.count("*").alias("size"), F.bit_xor(member).alias("x"), F.sum(member.cast("decimal(20,0)")).alias("s")).where(col("size") > 1)
    nodes = stage(nodes, "jaccard-nodes", few=True)
    # Leaves of different runs that hold the same sets are one, and searched once.
    one = nodes.groupBy("size", "x", "s").agg(F.min("id").alias("leaf"))
    nodes = stage(nodes.join(one, ["size", "x", "s"]).select("id", "leaf", "size"), "jaccard-one", few=True)
    placed = leaves.select("c", "run", "id").join(small_side(nodes, 40), "id")
    # Each set's leaf in each run; 0 where it is alone.
    each = placed.groupBy("c").agg(*(F.coalesce(F.max(F.when(col("run") == r, col("leaf"))), F.lit(0).cast("long")).alias(f"r{r}") for r in range(runs)))
    each = stage(each.select("c", F.array(*(f"r{r}" for r in range(runs))).alias("leaves")), "jaccard-paths", few=True)
    sizes = small_side(stage(nodes.select(col("leaf").alias("id"), "size").distinct(), "jaccard-sizes", few=True), 32)
    sample = classes.select("c", "n", "bytes")
    held = each.join(sample, "c").select("c", "n", "bytes", "leaves", F.explode(F.array_distinct(F.filter("leaves", lambda x: x != 0))).alias("id"))
    held = _block_pairs(held.join(sizes, "id"), block).select(*KEYS, "block", "c", "n", "bytes", "leaves")
    together = lambda rows: rows.repartition(*KEYS).sortWithinPartitions(*KEYS)
    hits = together(held).mapInPandas(_candidate_rows(similarity), "id long, i int, j int, block int, c long")
    hits = stage(hits, "jaccard-hits", few=True)
    wanted = hits.select("c").distinct().join(classes.select("c", "h1", "h2", "rep"), "c")
    wanted = small_side(stage(wanted, "jaccard-wanted", few=True), 64)
    texts = docs.join(wanted, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("c", "text")
    # A repeated row of a document comes twice; one of them goes on.
    sets = stage(texts.mapInPandas(_token_rows, "c long, tokens binary").dropDuplicates(["c"]), "jaccard-sets")
    pairs = hits.join(sets.join(each, "c").join(sample, "c"), "c")
    return together(pairs).mapInPandas(_exact_rows(similarity), "c long, root long, links long")


def join(docs: DataFrame, similarity: float = SIMILARITY, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, h1, h2 (the text's hash), class_id, n_copies, n_links, group_id, grouped.

    class_id: least doc_id of the documents with the same shingle set. n_links: other classes at the similarity or
    more. group_id: least class_id of the classes that links join. grouped: whether the group has another row.
    Texts of fewer than five words have one shingle, their words; null and empty texts have none, are in no class
    but their own and have no links. Repeated rows are copies; an empty table gives no rows. Other columns are left
    out.
    """
    col = F.col
    hashed = docs.select("doc_id", text_of().alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), F.col("text"))})
    # Ids pass as text: pandas would make floating-point numbers of them beside a null.
    schema = "doc_id string, h1 long, h2 long, s1 long, s2 long, n long, sk array<int>, bytes binary"
    sketches = hashed.select(F.col("doc_id").cast("string"), "text", "h1", "h2").mapInPandas(_sketch_rows, schema)
    sketches = stage(sketches.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "jaccard-sketches")
    # The representative is a whole row, so that its text and its id belong together.
    first = F.min(F.struct("doc_id", "h1", "h2")).alias("first")
    classes = sketches.where(col("n") > 0).groupBy("s1", "s2").agg(F.count("*").alias("n_copies"), first, F.min("doc_id").alias("class_id"), F.any_value("n").alias("n"), F.any_value("sk").alias("sk"), F.any_value("bytes").alias("bytes"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("c"), "s1", "s2", "n_copies", "class_id", "n", "sk", "bytes", col("first.doc_id").alias("rep"), col("first.h1").alias("h1"), col("first.h2").alias("h2")), "jaccard-classes")
    found = stage(_links(hashed, classes, similarity, leaf, block), "jaccard-links", few=True)
    links = found.groupBy("c").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(col("root").alias("a"), col("c").alias("b")), "jaccard-groups").select(col("node").alias("c"), "component")
    known = classes.select("c", "s1", "s2", "n_copies", "class_id").join(links, "c", "left").join(groups, "c", "left")
    known = stage(known.where((col("n_copies") > 1) | (col("n_links") > 0)), "jaccard-known", few=True)
    least = known.where(col("component").isNotNull()).groupBy("component").agg(F.min("class_id").alias("group_id"))
    known = known.join(small_side(stage(least, "jaccard-least", few=True), 32), "component", "left")
    known = small_side(stage(known.select("s1", "s2", "class_id", "n_copies", "n_links", F.coalesce("group_id", "class_id").alias("group_id")), "jaccard-info", few=True), 72)
    out = sketches.select("doc_id", "h1", "h2", "s1", "s2").join(known, ["s1", "s2"], "left")
    alone = col("n_copies").isNull()
    return out.select(
        "doc_id", "h1", "h2", F.when(alone, col("doc_id")).otherwise(col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(alone, col("doc_id")).otherwise(col("group_id")).alias("group_id"), (~alone).alias("grouped"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one row of each group, the one of least doc_id; columns as they are, whatever their names.

    Documents without any words are in no group and all stay; null ids sort before others; repeated rows are
    copies; an empty table stays empty.
    """
    col = F.col
    same = ["doc_id", "h1", "h2"]
    found = join(docs, similarity).where("grouped").groupBy("group_id", *same).agg(F.count("*").alias("n"))
    found = stage(found, "jaccard-grouped", few=True)
    first = found.groupBy("group_id").agg(F.min(F.struct(*same, "n")).alias("first"))
    # Each row of a group that is not its first goes; the first's copies of the same id are one.
    fate = found.join(first, "group_id").select(*same, (F.struct(*same).eqNullSafe(F.struct(*(col(f"first.{c}") for c in same)))).alias("stays"), col("first.n").alias("n"))
    # One document may be in one group only, but for texts that share their id.
    fate = small_side(stage(fate.select(*(col(c).alias(f"f_{c}") for c in fate.columns)), "jaccard-fate", few=True), 64)
    rows = packed(docs, "doc_id").withColumns({"h1": F.xxhash64(text_of("row.text")), "h2": F.xxhash64(F.lit(7), text_of("row.text"))})
    on = (col("h1") == col("f_h1")) & (col("h2") == col("f_h2")) & col("doc_id").eqNullSafe(col("f_doc_id"))
    kept = rows.join(fate, on, "left").where(F.coalesce("f_stays", F.lit(True)))
    again = F.coalesce(col("f_n") > 1, F.lit(False))
    kept = kept.where(~again).select("row").unionByName(kept.where(again).dropDuplicates(["doc_id", "h1", "h2"]).select("row"))
    return kept.select(*(col(f"row.`{c}`") for c in docs.columns))
