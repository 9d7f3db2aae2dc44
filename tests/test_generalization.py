"""Rotations against views made one by one; score stores against plain joins, and their plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetward.operators import frontier, generalization, policies, splits
from fleetward.sources import score_store


def fleet(spark):
    rng = np.random.default_rng(2)
    rows = []
    for seed in (0, 1):
        for c, shift in (("a", 3.0), ("b", 1.5)):
            for split, n in (("benign_frontier", 120), ("benign_final_cal", 60), ("benign_test", 80)):
                rows += [(seed, c, "benign", None, float(x), split) for x in rng.normal(size=n)]
            for k, s in enumerate(("p", "q", "r", "s")):
                for split, n in (("attack_validation", 30), ("attack_test", 20)):
                    rows += [(seed, c, "attack", s, float(x), split) for x in rng.normal(shift - k / 2, 1, n)]
    return spark.createDataFrame(rows, "seed long, client_id string, label string, attack_subtype string, score double, split string").repartition(3)


def test_rotations():
    assert generalization.rotations({"f1": ["p"], "f2": ["q", "r"], "f3": ["s"]})["f2"] == (["q", "r"], ["p", "s"])
    assert list(generalization.transfers(["p"], ["q"], ("x", "y"))) == ["x to y", "y to x"]
    for bad in ({"f1": ["p"]}, {"f1": ["p"], "f2": ["p"]}, {"f1": ["p"], "f2": []}):
        with pytest.raises(ValueError):
            generalization.rotations(bad)


def test_runs_equal_single_views(spark):
    """Three rotations at two budgets for all policies in one run, against a run for one view."""
    df = fleet(spark)
    folds = generalization.rotations({"f1": ["p"], "f2": ["q", "r"], "f3": ["s"]})
    weights, budgets = frontier.equal_weights(df.select("client_id").distinct()), {"b1": 0.01, "b2": 0.04}
    settings = {"grid": (0.0, 0.01, 0.05), "min_client": 20, "min_rows": 10}
    views = generalization.views(df, folds)
    for name, (v, t) in folds.items():
        want = splits.restrict_subtypes(df, v, t)
        assert sorted(map(str, views.where(F.col("direction") == name).drop("direction").collect())) == sorted(map(str, want.collect()))
    got = generalization.run(df, weights, folds, budgets, **settings)["evaluations"]
    rows = {(r["direction"], r["seed"], r["budget_id"], r["policy"]): r for r in got.collect()}
    assert len(rows) == 3 * 2 * 2 * len(policies.POLICIES) and dict(got.dtypes)["seed"] == "bigint"
    _, alone = policies.run_all(splits.restrict_subtypes(df, *folds["f2"]), weights, budgets, **settings)
    for r in alone.collect():
        own = rows["f2", r["seed"], r["budget_id"], r["policy"]]
        for c in ("macro_recall", "worst_recall", "fleet_fpr", "status"):
            assert own[c] == r[c] or abs(own[c] - r[c]) < 1e-12


def test_score_store(spark, tmp_path):
    rows = [(c, f, k, float(k) / 7, "x") for c in ("a", "b", "c") for f in ("f1", "f2") for k in range(50)]
    scores = spark.createDataFrame(rows, "client_id string, source_file string, source_row long, score double, note string").repartition(5)
    path, schema = str(tmp_path / "store"), "client_id string, source_file string, source_row bigint, score double, note string"
    score_store.write_store(scores, "fleetward_scores_1", path, buckets=4)
    store = score_store.open_store(spark, "fleetward_scores_2", path, schema, buckets=4)
    timed = spark.createDataFrame([("a", "f1", 3, 9.0), ("a", "f1", 3, 9.5), ("b", "f9", 3, 1.0), ("", "f1", 1, 1.0), ("c", "f2", 49, None), (None, "f1", 1, 2.0), ("c", "f2", 48, 4.0)], "client_id string, source_file string, source_row long, t double")
    timed = timed.withColumns({"label": F.lit("benign"), "attack_subtype": F.lit(None).cast("string")})
    for name in ("fleetward_scores_1", "fleetward_scores_2"):
        got = score_store.timed_lookup(timed, spark.table(name))
        assert sorted((r["client_id"], r["t"], r["score"]) for r in got.collect()) == [("a", 9.0, 3 / 7), ("a", 9.5, 3 / 7), ("c", 4.0, 48 / 7)]
    assert score_store.lookup(timed, store, how="left").count() == 7
    # The scores stay where they are: the one exchange is that of the rows that ask.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = score_store.timed_lookup(timed, store)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    reads = plan[: plan.index("SelectedBucketsCount")]
    assert "Exchange" not in reads[reads.rindex("SortAggregate" if "SortAggregate" in reads else "HashAggregate") :]
    twice = scores.unionByName(scores.where("client_id = 'a' and source_row = 3"))
    score_store.write_store(twice, "fleetward_scores_3", str(tmp_path / "twice"), buckets=4)
    with pytest.raises(Exception, match="several scores of a/f1/3"):
        score_store.timed_lookup(timed, spark.table("fleetward_scores_3")).collect()
    for k in (1, 2, 3):
        spark.sql(f"DROP TABLE fleetward_scores_{k}")
