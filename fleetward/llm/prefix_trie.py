"""Conversations that share beginnings, as a trie, summed along heavy paths.

A node stands for a sequence of turns that some conversation begins with. Turns are known by
their SHA-256; a beginning is known by its length and two 64-bit words, each the exclusive or of
one hash of (place, turn) for each of its turns, so that beginnings are running values and a
conversation of any length is worked out slice by slice, not in one task.

Subtrees are summed by heavy-path decomposition. The heavy child of a node is its child with the
most conversations; heavy edges make paths, and a step to any other child at least halves the
conversations, so no way down from the root has more such steps than the logarithm of their
number. Paths, one row each, take their totals from the deepest level up, and hand them to the
nodes that they hang on; a suffix sum along each path, by slices of depth, then gives the sum of
every subtree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fleetward.llm.common import stage, text_of, words_of

#: Rows of one conversation, or one path, that are worked on together.
SLICE = 1024
#: Conversations of one id range whose ids become one piece of text: 2 to this power.
PIECE_BITS = 12

col = F.col


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, pos, fp, words) of every turn, pos from 1 by turn (null first), and (c, n) of every conversation.

    Turns are dealt out by ranges of (conversation, turn) and numbered within them; counts of what a conversation
    has in each range put the numbers together.
    """
    role, text = text_of("role"), text_of("text")
    fp = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(col("conv_id").cast("long").alias("c"), "turn", fp.alias("fp"), F.size(words_of(text)).cast("long").alias("words")).where(col("c").isNotNull())
    order = ["c", "turn", "fp", "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    turns = stage(dealt.select("c", "fp", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")), "trie-turns")
    parts = turns.groupBy("c", "part").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    upto = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "trie-parts", few=True)
    pos = turns.join(parts.drop("n"), ["c", "part"]).select("c", (col("before") + col("i") - col("least") + 1).alias("pos"), "fp", "words")
    return pos, parts.groupBy("c").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame, spread: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others: (c, depth, fp, words, len) of their turns, and (c, len) of all.

    Conversation c takes the first h turns of conversation c - c % spread, as many as that has, and goes on with its
    own turns after its first h; h is the CRC-32 of c in decimal, modulo most.
    """
    pos, convs = placed(conversations)
    pos = stage(pos, "trie-places")
    own = convs.select("c", "n", (F.crc32(col("c").cast("string").cast("binary")) % most).alias("h"), (col("c") - col("c") % spread).alias("base"))
    bases = convs.select(col("c").alias("base"), col("n").alias("n_base"))
    used = F.least(col("h"), F.coalesce("n_base", F.lit(0)))
    info = own.join(bases, "base", "left").select("c", "h", "base", used.alias("used"), (used + F.greatest(col("n") - col("h"), F.lit(0))).alias("len"))
    info = stage(info, "trie-lengths", few=True)
    after = pos.join(info.select("c", "h", "used", "len"), "c").where(col("pos") > col("h")).select("c", (col("pos") - col("h") + col("used")).alias("depth"), "fp", "words", "len")
    # At most most - 1 rows of a conversation, each taken by spread others at the most.
    heads = pos.where((col("pos") < most) & (col("c") % spread == 0)).select(col("c").alias("base"), "pos", "fp", "words")
    before = info.where(col("used") > 0).join(heads, "base").where(col("pos") <= col("used")).select("c", col("pos").alias("depth"), "fp", "words", "len")
    return after.unionByName(before), info.select("c", "len")


#: A running value: its aggregate, what it takes of a row, how what is before joins what is in the slice, and whether the row itself counts.
Running = tuple[Callable[[Column], Column], Column, Callable[[Column, Column], Column], bool]


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, Running], upward: bool = False) -> DataFrame:
    """Adds running values along order (whole numbers from 0, at most one row each), without one task for a key.

    upward: from the greatest order down. Slices of SLICE places are aggregated, their results run along the key,
    and each row joins what the slices before it have with what its own slice has up to it. df is read twice: a
    staged table.
    """
    cut = df.withColumn("__slice", F.floor(col(order) / SLICE).cast("long") * (-1 if upward else 1))
    own = [*keys, "__slice"]
    totals = cut.groupBy(*own).agg(*(f(x).alias(f"__t_{k}") for k, (f, x, _, _) in values.items()))
    slices = Window.partitionBy(*keys).orderBy("__slice")
    upto = slices.rowsBetween(Window.unboundedPreceding, -1)
    # The first slice of a key has nothing before it, and most keys have no other.
    carry = totals.select(*own, F.row_number().over(slices).alias("__nr"), *(f(col(f"__t_{k}")).over(upto).alias(f"__c_{k}") for k, (f, _, _, _) in values.items()))
    carry = carry.where(col("__nr") > 1).drop("__nr")
    rows = Window.partitionBy(*own).orderBy(col(order).desc() if upward else col(order))
    frame = {True: rows.rowsBetween(Window.unboundedPreceding, Window.currentRow), False: rows.rowsBetween(Window.unboundedPreceding, -1)}
    out = cut.select("*", *(f(x).over(frame[with_row]).alias(f"__i_{k}") for k, (f, x, _, with_row) in values.items())).join(carry, own, "left")
    for k, (_, _, both, _) in values.items():
        before, inside = col(f"__c_{k}"), col(f"__i_{k}")
        out = out.withColumn(k, F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(both(before, inside)))
    return out.select(*df.columns, *values)


def _members(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each conversation and each of its beginnings, the empty one as well: key (depth, k1, k2), key of the parent."""
    hashed = stage(turns.select("c", "depth", F.xxhash64(F.lit(1), "depth", "fp").alias("x1"), F.xxhash64(F.lit(2), "depth", "fp").alias("x2"), "words", "len"), "trie-hashes")
    xor = lambda a, b: a.bitwiseXOR(b)
    out = running(hashed, ["c"], "depth", {"k1": (F.bit_xor, col("x1"), xor, True), "k2": (F.bit_xor, col("x2"), xor, True)})
    out = out.select("c", "depth", "k1", "k2", xor(col("k1"), col("x1")).alias("p1"), xor(col("k2"), col("x2")).alias("p2"), "words", (col("depth") == col("len")).alias("last"))
    zero = F.lit(0).cast("long")
    roots = lengths.select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("words"), (col("len") == 0).alias("last"))
    return stage(out.unionByName(roots), "trie-members")


def _tree(members: DataFrame) -> DataFrame:
    """One row a node: its key, smallest conversation m, n, words, ends, children, parent's m, and whether it is a light child."""
    key, parent = ["depth", "k1", "k2"], ["depth", "p1", "p2"]
    nodes = members.groupBy(*key).agg(
        F.min("c").alias("m"), F.count("*").alias("n"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count_if("last").alias("n_ends"), F.min(F.when(col("last"), col("c"))).alias("end"),
    )
    nodes = stage(nodes, "trie-nodes", few=True)
    up = nodes.where(col("depth") > 0).groupBy((col("depth") - 1).alias("depth"), "p1", "p2").agg(F.count("*").alias("n_children"), F.max(F.struct("n", (-col("m")).alias("minus"))).alias("heavy"))
    parents = up.join(nodes.select("depth", col("k1").alias("p1"), col("k2").alias("p2"), col("m").alias("parent_m")), parent)
    parents = stage(parents.select("depth", "p1", "p2", "n_children", "parent_m", (-col("heavy.minus")).alias("heavy_m")), "trie-parents", few=True)
    own = parents.select("depth", col("p1").alias("k1"), col("p2").alias("k2"), "n_children")
    above = parents.select((col("depth") + 1).alias("depth"), "p1", "p2", "parent_m", "heavy_m")
    out = nodes.join(own, key, "left").join(above, parent, "left")
    light = F.coalesce(col("m") != col("heavy_m"), F.lit(True))
    return stage(out.select(*key, "m", "n", "words", "n_ends", "end", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "parent_m", light.alias("light")), "trie-tree", few=True)


def _on_paths(members: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the head (hd, hm) of their path, its level and, of heads, the head (ad, am) of the path above; and the
    conversations that end at a node together with others.

    A node is known by its depth and smallest conversation. Along any conversation of a node, its path's head is the
    last light node down to it, and its level the number of those.
    """
    of_node = F.struct("n", "words", "n_ends", "end", "n_children", "parent_m")
    walks = members.select("c", "depth", "k1", "k2", "last").join(tree, ["depth", "k1", "k2"])
    walks = stage(walks.select("c", "depth", "m", "light", (col("last") & (col("n_ends") > 1)).alias("shared"), F.when(col("c") == col("m"), of_node).alias("node")), "trie-walks")
    light = F.when(col("light"), F.struct("depth", "m"))
    later = lambda a, b: b
    out = running(walks, ["c"], "depth", {"head": (F.max, light, later, True), "above": (F.max, light, later, False), "level": (F.sum, col("light").cast("long"), lambda a, b: a + b, True)})
    out = out.where(col("node").isNotNull()).select("m", "depth", col("head.depth").alias("hd"), col("head.m").alias("hm"), "level", F.when(col("light"), col("above.depth")).alias("ad"), F.when(col("light"), col("above.m")).alias("am"), "node.*")
    return stage(out, "trie-paths", few=True), walks.where("shared").select("m", "depth", "c")


def _hung(nodes: DataFrame) -> DataFrame:
    """(m, depth, leaves, saved): what the light children's subtrees of a node sum to, by rounds over the paths, deepest level first."""
    leaf, saved = (col("n_children") == 0).cast("long"), (col("n") - 1) * col("words")
    head = F.when(col("depth") == col("hd"), F.struct("ad", "am", "parent_m"))
    paths = nodes.groupBy("hd", "hm").agg(F.sum(leaf).alias("leaves"), F.sum(saved).alias("saved"), F.max("level").alias("level"), F.max(head).alias("head"))
    paths = stage(paths.select("hd", "hm", "leaves", "saved", "level", "head.*"), "trie-sums", few=True)
    # Down from the root, conversations halve at least at each level: 64 of them at the most.
    deepest = paths.agg(F.max("level")).first()[0] or 1
    done, below = [], None
    for level in range(deepest, 1, -1):
        now = paths.where(col("level") == level)
        if below is not None:
            now = now.join(below, ["hd", "hm"], "left").withColumns({k: col(k) + F.coalesce(f"more_{k}", F.lit(0)) for k in ("leaves", "saved")})
        now = stage(now.select("hd", "ad", "am", "parent_m", "leaves", "saved"), "trie-level", few=True)
        below = now.groupBy(col("ad").alias("hd"), col("am").alias("hm")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        done.append(now.select(col("parent_m").alias("m"), (col("hd") - 1).alias("depth"), "leaves", "saved"))
    if not done:
        return nodes.select("m", "depth", leaf.alias("leaves"), saved.alias("saved")).where(F.lit(False))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.groupBy("m", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _ends(shared: DataFrame) -> DataFrame:
    """(m, depth, sha) of nodes where several conversations end: ids become pieces of text side by side, and one task
    a node feeds its pieces to SHA-256, which is sequential, one after the other."""
    pieces = shared.groupBy("m", "depth", F.shiftright("c", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out = None, None, []
        for batch in batches:
            for m, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("m", "depth", "ids")), strict=True):
                if (m, depth) == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (m, depth), sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("m", "depth", "sha"), r, strict=True)) for r in out])
                out = []
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"m": at[0], "depth": at[1], "sha": sha.hexdigest()}])

    schema = StructType([StructField("m", LongType()), StructField("depth", LongType()), StructField("sha", StringType())])
    return pieces.repartition("m", "depth").sortWithinPartitions("m", "depth", "piece").select("m", "depth", "ids").mapInArrow(digest, schema)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 (all but the last long).

    A node's conv_id is the smallest of the conversations that begin with it. Null roles and texts are empty, and an
    empty text is a turn all the same. Turns go by turn, null first; turns of one number go by the SHA-256 of role
    and text; repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out,
    other columns as well. An empty table gives no rows, not even a root. Texts count whole, whatever their length.
    """
    turns, lengths = rebuilt(conversations)
    return trie(turns, lengths)


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The same of turns (c, depth from 1, fp, words, len) and lengths (c, len) that are there already."""
    members = _members(turns, lengths)
    nodes, shared = _on_paths(members, _tree(members))
    leaf, saved = (col("n_children") == 0).cast("long"), (col("n") - 1) * col("words")
    own = nodes.join(_hung(nodes), ["m", "depth"], "left")
    zero = F.lit(0).cast("long")
    own = own.select("m", "depth", "hd", "hm", "parent_m", "n", "n_children", "n_ends", "end", (leaf + F.coalesce("leaves", zero)).alias("leaves"), (saved + F.coalesce("saved", zero)).alias("saved"))
    plus = lambda a, b: a + b
    sums = running(stage(own, "trie-own", few=True), ["hd", "hm"], "depth", {"n_leaves": (F.sum, col("leaves"), plus, True), "saved_tokens": (F.sum, col("saved"), plus, True)}, upward=True)
    alone = F.when(col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(col("n_ends") == 1, F.sha2(col("end").cast("string"), 256))
    out = sums.join(_ends(shared), ["m", "depth"], "left")
    return out.select(col("m").alias("conv_id"), "depth", col("parent_m").alias("parent_conv_id"), col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce(alone, col("sha")).alias("ends_sha256"))


#: The same in DuckDB's SQL, with subtrees by way of all beginnings of all nodes.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id AS c, turn, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS fp,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, fp) AS pos FROM t),
v AS (
  SELECT c, n, c - c % 20 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM p GROUP BY c)),
u AS (SELECT v.*, least(v.h, coalesce(b.n, 0)) AS used, least(v.h, coalesce(b.n, 0)) + greatest(v.n - v.h, 0) AS length FROM v LEFT JOIN v b ON b.c = v.base),
r AS (
  SELECT u.c, p.pos - u.h + u.used AS depth, fp, words FROM u JOIN p ON p.c = u.c AND p.pos > u.h
  UNION ALL SELECT u.c, p.pos, fp, words FROM u JOIN p ON p.c = u.base AND p.pos <= u.used),
k AS (
  SELECT r.c, depth, words, sha256(string_agg(fp, ',') OVER (PARTITION BY r.c ORDER BY depth)) AS k, depth = u.length AS ends FROM r JOIN u ON u.c = r.c
  UNION ALL SELECT c, 0, 0, '', length = 0 FROM u),
n AS (SELECT depth, k, min(c) AS m, count(*) AS n, min(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends FROM k GROUP BY depth, k),
q AS (SELECT n.*, a.m AS up FROM n LEFT JOIN k ON k.c = n.m AND k.depth = n.depth - 1 LEFT JOIN n a ON a.depth = k.depth AND a.k = k.k),
w AS (SELECT up AS m, depth - 1 AS depth, count(*) AS children FROM q WHERE up IS NOT NULL GROUP BY up, depth),
e AS (SELECT q.*, coalesce(children, 0) AS children FROM q LEFT JOIN w USING (m, depth)),
s AS (
  SELECT k.depth, k.k, sum(CASE WHEN e.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((e.n - 1) * e.words) AS saved
  FROM e JOIN k ON k.c = e.m AND k.depth <= e.depth GROUP BY k.depth, k.k)
SELECT m AS conv_id, depth, up AS parent_conv_id, n AS n_convs, CAST(children AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM e JOIN s USING (depth, k)
"""
