"""Commits of several tables, and scores that are materialised seed by seed."""

import os

import pytest
from pyspark.sql import functions as F

from fleetward.sources import commits, timed


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("x"))


def failing(spark):
    return spark.range(4).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("lost"))).cast("long").alias("x"))


def test_commits_are_whole_or_not_there(spark, tmp_path):
    """A loss between two tables leaves the state before; what it wrote goes with tidy()."""
    path = str(tmp_path / "set")
    assert commits.current(spark, path) == {} and commits.mark(spark, path) is None
    assert commits.commit(spark, path, {"a": numbers(spark, 3), "b": numbers(spark, 5)}, facts={"why": "first"}) == 1
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, path, {"a": numbers(spark, 100), "b": failing(spark)})
    assert {n: t.count() for n, t in commits.current(spark, path).items()} == {"a": 3, "b": 5}
    assert commits.mark(spark, path)["facts"] == {"why": "first"} and len(os.listdir(f"{path}/tables")) == 2
    assert commits.commit(spark, path, {"a": numbers(spark, 7)}) == 2
    assert {n: t.count() for n, t in commits.current(spark, path).items()} == {"a": 7}
    assert {n: t.count() for n, t in commits.current(spark, path, 1).items()} == {"a": 3, "b": 5}
    commits.tidy(spark, path)
    assert len(os.listdir(f"{path}/tables")) == 1 and commits.current(spark, path)["a"].count() == 7
    assert commits.commit(spark, path, {"a": numbers(spark, 0)}) == 3 and commits.current(spark, path)["a"].columns == ["x"]


def test_of_two_commits_at_once_one_wins(spark, tmp_path):
    path = str(tmp_path / "set")
    commits.commit(spark, path, {"a": numbers(spark, 1)})
    mark = f"{path}/marks/00000002.json"
    commits._put(spark, mark, '{"id": "other", "schemas": {}, "facts": {}}')
    with pytest.raises(commits.Conflict):
        commits._put(spark, mark, "{}")
    assert commits.mark(spark, path)["id"] == "other" and not [x for x in os.listdir(f"{path}/marks") if x.endswith(".tmp") or (x.startswith(".") and not x.endswith(".crc"))]


def rows(spark, clients):
    out = []
    for c, benign in clients.items():
        out += [(c, f"{'ba'[k % 2]}.csv", k, "benign", None, [float(k), float(k * k % 7)]) for k in range(benign)]
        out += [(c, "z.csv", k, "attack", "pq"[k % 2], [50.0 + k, 1.0]) for k in range(20)]
    return spark.createDataFrame(out, "client_id string, source_file string, source_row long, label string, attack_subtype string, x array<double>").repartition(3)


def first_component(train, rows, seed):
    return rows.withColumn("score", F.get("z", F.lit(0)) + F.lit(float(seed)))


def test_materialised_scores(spark, tmp_path):
    path = str(tmp_path)
    df = rows(spark, {"a": 40, "b": 10, "lazy": 1})
    assert timed.materialise(spark, df, path, "d", [3, 4], first_component) == {3: "WRITTEN", 4: "WRITTEN"}
    got = commits.current(spark, timed.place(path, "d", 3))
    assert {r["client_id"] for r in got["scaler"].collect()} == {"a", "b"}
    scores = got["scores"].collect()
    # By file, then row: a.csv's odd rows come before b.csv's even ones.
    order = [("a.csv", k) for k in range(1, 40, 2)] + [("b.csv", k) for k in range(0, 40, 2)]
    bounds = {"benign_train": order[:20], "benign_frontier": order[20:28], "benign_final_cal": order[28:32], "benign_test": order[32:]}
    for split, want in bounds.items():
        assert sorted((r["source_file"], r["source_row"]) for r in scores if (r["client_id"], r["split"]) == ("a", split)) == sorted(want)
    assert sum(r["split"] == "attack_validation" for r in scores if r["client_id"] == "a") == 4 and {r["client_id"] for r in scores} == {"a", "b"}
    train = [k for _, k in order[:20]]
    mean = sum(train) / 20
    sd = (sum((k - mean) ** 2 for k in train) / 20) ** 0.5
    assert all(abs(r["score"] - ((r["source_row"] + (50 if r["label"] == "attack" else 0) - mean) / sd + 3)) < 1e-9 for r in scores if r["client_id"] == "a")
    assert {r["sample_id"] for r in scores if r["source_row"] == 1 and r["source_file"] == "a.csv"} == {"a|a.csv|1", "b|a.csv|1"}
    assert timed.scores_of(spark, path, "d", 4).where("split = 'benign_train'").count() == 0
    with pytest.raises(ValueError, match="no scores"):
        timed.scores_of(spark, path, "d", 9)


def test_what_is_there_is_reused_and_what_is_lost_is_done_again(spark, tmp_path):
    path, df = str(tmp_path), rows(spark, {"a": 20, "b": 20})

    def breaks_at_two(train, own, seed):
        return first_component(train, own, seed) if seed != 2 else own.withColumn("score", F.when(F.col("source_row") >= 0, F.raise_error(F.lit("lost"))).cast("double"))

    with pytest.raises(Exception, match="lost"):
        timed.materialise(spark, df, path, "d", [1, 2, 3], breaks_at_two)
    assert commits.current(spark, timed.place(path, "d", 2)) == {}
    assert timed.materialise(spark, df, path, "d", [1, 2, 3], first_component) == {1: "REUSED", 2: "WRITTEN", 3: "WRITTEN"}
    assert timed.materialise(spark, rows(spark, {"a": 20, "b": 20, "new": 20}), path, "d", [1], first_component) == {1: "WRITTEN"}
    assert commits.mark(spark, timed.place(path, "d", 1))["number"] == 2
    with pytest.raises(ValueError, match="no client"):
        timed.materialise(spark, rows(spark, {"a": 1}), path, "e", [1], first_component)
    tables = {s: {"metrics": timed.scores_of(spark, path, "d", s).groupBy("client_id").count()} for s in (1, 2)}
    assert timed.persist_tables(spark, f"{path}/events", tables) == 1
    assert {(r["seed"], r["client_id"]) for r in commits.current(spark, f"{path}/events")["metrics"].collect()} == {(1, "a"), (1, "b"), (1, "new"), (2, "a"), (2, "b")}


def test_staged_tables_go_with_their_scope(spark):
    from fleetward.staging import released, staged

    with released(spark):
        one = staged(spark.range(3), "one")
        with released(spark):
            two = staged(spark.range(4), "two")
            assert two.count() == 4
        assert one.count() == 3
        with pytest.raises(Exception):
            two.select("id").collect()
