"""Numbers, hash trees, states of cells and runs of what has changed."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetward.operators import checks, incremental, ordering
from fleetward.sources import commits


def text_digest(parts):
    h = hashlib.sha256()
    for p in parts:
        h.update(b"\xff" * 8 if p is None else len(p.encode()).to_bytes(8, "big") + p.encode())
    return h.digest()


def tree(rows, fanout):
    level = [text_digest(r) for r in rows]
    n, first = len(level), True
    while first or len(level) > 1:
        level = [hashlib.sha256(b"".join(level[k : k + fanout])).digest() for k in range(0, len(level), fanout)]
        first = False
    return hashlib.sha256(n.to_bytes(8, "big") + level[0]).hexdigest()


@pytest.mark.parametrize("partitions, fanout", [(1, 4), (7, 4), (3, 1000)])
def test_hash_tree_at_any_partitioning(spark, partitions, fanout):
    rng = np.random.default_rng(0)
    rows = [(k, f"f{rng.integers(0, 3)}", int(o), [None, "", "é|1:", "x"][rng.integers(0, 4)]) for k, n in (("a", 90), ("b", 1), (None, 17), ("c", 4), ("d", 5)) for o in rng.permutation(n)]
    df = spark.createDataFrame(rows, "k string, file string, row long, cell string").repartition(partitions)
    got = {r["k"]: (r["n"], r["digest"]) for r in ordering.ordered_digest(df, ["k"], ["file", "row"], ["file", "row", "cell"], fanout).collect()}
    for k in ("a", "b", None, "c", "d"):
        own = sorted((f, o, x) for q, f, o, x in rows if q == k)
        assert got[k] == (len(own), tree([(f, str(o), x) for f, o, x in own], fanout))
    nr = {(r["k"], r["file"], r["row"]): r["nr"] for r in ordering.numbered(df, ["k"], ["file", "row"]).collect()}
    for k in ("a", None):
        assert [nr[k, f, o] for f, o in sorted((f, o) for q, f, o, _ in rows if q == k)] == list(range(sum(q == k for q, *_ in rows)))


def test_digest_tells_order_and_cells(spark):
    of = lambda rows: ordering.ordered_digest(spark.createDataFrame(rows, "k string, o long, a string, b string"), ["k"], ["o"], ["a", "b"]).first()["digest"]
    one = of([("k", 1, "x", "y"), ("k", 2, "z", None)])
    assert one == of([("k", 7, "z", None), ("k", 5, "x", "y")])
    assert len({one, of([("k", 2, "x", "y"), ("k", 1, "z", None)]), of([("k", 1, "xy", ""), ("k", 2, "z", None)]), of([("k", 1, "x", "y"), ("k", 2, "z", "")]), of([("k", 1, "x", "y")])}) == 5


def test_states(spark):
    expected = spark.createDataFrame([(k, "d") for k in range(7)], "cell int, digest string")
    rows = []
    for k in range(1, 7):
        rows.append((k, "evaluation", "old" if k == 3 else "d", k != 4))
        if k != 2:
            rows.append((k, "results", "d", k != 6))
    rows += [(2, "other", "d", True), (9, "evaluation", "d", True), (5, "results", "d", True), (3, "results", "d", False)]
    stored = spark.createDataFrame(rows, "cell int, part string, digest string, ok boolean")
    got = {r["cell"]: r["state"] for r in incremental.cell_states(expected, stored, ["cell"], "evaluation", ["results"]).collect()}
    assert got == {0: "MISSING", 1: "VALID", 2: "INCOMPLETE", 3: "STALE", 4: "MALFORMED", 5: "VALID", 6: "MALFORMED"}
    states = incremental.cell_states(expected, stored, ["cell"], "evaluation", ["results"])
    assert checks.ladder(states).first()["state"] == "EXECUTION_INCOMPLETE"
    assert [checks.ladder(states.where(F.col("cell").isin(x))).first()["state"] for x in ([1, 2], [1, 3], [1, 5], [1, 6])] == ["EVIDENCE_INCOMPLETE", "STALE", "PASSED", "FAILED"]
    want = spark.createDataFrame([(1, "m", "p"), (2, "m", "p"), (3, "m", None)], "seed int, model string, data string")
    have = spark.createDataFrame([(1, "m", "p"), (2, "m", "q"), (3, "m", None)], "seed int, model string, data string")
    assert {r["seed"] for r in incremental.reusable(want, have, ["seed"], ["model", "data"]).collect()} == {1, 3}


def test_only_what_has_changed_runs_again(spark, tmp_path):
    path, ran = str(tmp_path / "cells"), []

    def run(own):
        ran.append({r["device"] for r in own.select("device").distinct().collect()})
        return own.groupBy("device").agg(F.sum("x").alias("total"))

    def inputs(**changed):
        rows = [(d, k, changed.get(d, 1.0) * k) for d in ("a", "b", "c") if changed.get(d) != 0 for k in range(20)]
        return spark.createDataFrame(rows, "device string, row long, x double").repartition(3)

    refresh = lambda df, **more: {r["device"] for r in incremental.refresh(spark, path, df, ["device"], ["row"], run, **more).collect()}
    totals = lambda: {r["device"]: r["total"] for r in incremental.outputs(spark, path, ["device"]).collect()}
    with pytest.raises(ValueError, match="nothing"):
        totals()
    assert refresh(inputs()) == {"a", "b", "c"} == ran[-1] and totals() == {"a": 190.0, "b": 190.0, "c": 190.0}
    assert refresh(inputs()) == set() and len(ran) == 1
    assert refresh(inputs(b=2.0)) == {"b"} == ran[-1] and totals() == {"a": 190.0, "b": 380.0, "c": 190.0}
    assert refresh(inputs(b=2.0, c=0)) == set() and totals() == {"a": 190.0, "b": 380.0}
    assert refresh(inputs(b=2.0)) == {"c"} and totals()["c"] == 190.0
    assert refresh(inputs(b=2.0), version="2") == {"a", "b", "c"} and commits.mark(spark, path)["number"] == 5

    def fails(own):
        return own.groupBy("device").agg(F.max(F.raise_error(F.lit("lost")).cast("double")).alias("total"))

    with pytest.raises(Exception, match="lost"):
        incremental.refresh(spark, path, inputs(), ["device"], ["row"], fails)
    assert totals() == {"a": 190.0, "b": 380.0, "c": 190.0} and refresh(inputs(), version="2") == {"b"}
