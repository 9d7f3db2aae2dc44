"""op12 against a trie of dictionaries and against SQL."""

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from parity import assert_same, by_sql
from pyspark.sql import functions as F

from fleetward.llm import prefix_trie
from fleetward.llm.queries import op12_prefix_trie

SF = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len((role or '').encode())}:{role or ''}{text or ''}"), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]
    nodes = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)]
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(key))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below), len(leaves), saved, sha(ends)))
    return sorted(out)


def rows_of(df):
    assert df.columns == NAMES
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, c string, depth int")


@pytest.mark.parametrize("slice_rows", [2, 1024])
def test_equals_dictionaries(spark, monkeypatch, slice_rows):
    """Few words, so that beginnings are shared; with slices of two, conversations and paths are cut over and over."""
    monkeypatch.setattr(prefix_trie, "SLICE", slice_rows)
    rng = np.random.default_rng(slice_rows)
    rows = []
    for c in rng.permutation(140).tolist():
        for turn in range(int(rng.integers(1, 8))):
            rows.append((c, turn, ["user", "assistant"][turn % 2], " ".join(rng.choice(["a", "b"], int(rng.integers(0, 2)) + (turn > 2)))))
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "of nobody"), (1, None, "user", "first"), (1, 5, None, None), (1, 5, "user", "tie"), (1, 5, "user", "tie"), (1, 2, "", "x\x0by z"), (20, 0, "user", "base"), (21, 3, "user", "alone"),
        (22, 0, "user", "a:b"), (22, 1, "us", "era:b"), (-3, 0, "user", "minus"), (-20, 0, "user", "below zero"), (33, 0, "user", "word " * 50_000), (40, 0, "user", "base"), (41, 0, "user", "base"), (41, 1, None, ""), (9_000_000_000, 0, "user", "base"),
    ]
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_long_conversation_and_many_copies(spark, monkeypatch):
    """One conversation has most turns, one beginning most conversations, one end many of them, over several id ranges."""
    monkeypatch.setattr(prefix_trie, "SLICE", 64)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 4)
    rows = [(7, k, "user", f"t{k % 5} w") for k in range(300)]
    rows += [(c, k, "user", f"same {k}") for c in range(100, 400) for k in range(5)]
    rows += [(c, k, "user", f"t{k % 5} w") for c in (27, 47) for k in range(250)]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.prefix_trie(table(spark, rows)).collect()}
    # The plain version compares all nodes with all: here its counts by dictionaries of beginnings.
    turns = {}
    for c, _, role, text in rows:
        turns.setdefault(c, []).append((role, text))
    full = {c: turns.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + t[zlib.crc32(str(c).encode()) % 4 :] for c, t in turns.items()}
    members = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    assert len(got) == len(members)
    below = {k: [0, 0] for k in members}
    parents = {k[:-1] for k in members if k}
    for k, m in members.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += k not in parents
            below[k[:d]][1] += (len(m) - 1) * len(k[-1][1].split()) if k else 0
    for k, m in members.items():
        r = got[min(m), len(k)]
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(k))
        assert (r["n_convs"], [r["n_leaves"], r["saved_tokens"]], r["ends_sha256"]) == (len(m), below[k], sha(ends))


def test_no_rows(spark):
    assert rows_of(prefix_trie.prefix_trie(table(spark, []).where(F.lit(False)))) == []
    assert rows_of(prefix_trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []


def test_running_values(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 3)
    rows = [(k, i, i * i - 7 * k) for k in range(3) for i in range(k * 5 + 1)]
    df = spark.createDataFrame(rows, "k long, i long, x long")
    plus = lambda a, b: a + b
    for upward in (False, True):
        out = prefix_trie.running(df, ["k"], "i", {"s": (F.sum, F.col("x"), plus, True), "b": (F.sum, F.col("x"), plus, False)}, upward).collect()
        for r in out:
            mine = [x for k, i, x in rows if k == r["k"] and (i > r["i"] if upward else i < r["i"])]
            assert r["b"] == (sum(mine) if mine else None) and r["s"] == sum(mine) + r["x"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_equals_sql(spark):
    assert_same(op12_prefix_trie(spark, SF).toPandas(), by_sql(SF, prefix_trie.ORACLE_SQL))
