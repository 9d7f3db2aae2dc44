"""External captures from the tree of files to the run's tables."""

import os

import pytest
from pyspark.sql import functions as F

from fleetward.sources import captures, commits, external, tables, timed

MAC = {c: f"aa:00:00:00:00:0{k}" for k, c in enumerate("abcd")}


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def tree(root):
    """Columns in another order in each file, one of text, one that is a number too seldom; a column that one file has."""
    for part in (0, 1):
        write(f"{root}/Benign/b{part}.csv", [["src_mac,dst_mac,f1,note,f2,odd", "odd,f2,note,f1,dst_mac,src_mac"][part]] + [
            ",".join([MAC[c], "ff:ff:ff:ff:ff:ff", str(k + part), "text", str(k % 5), "1" if k % 2 else "x"][:: 1 - 2 * part]) for c in "abc" for k in range(150)])
    write(f"{root}/Benign/rare.csv", ["src_mac,f2,f1,extra"] + [f"{MAC['d']},1,2,7"] * 3)
    for kind, sub, shift in (("DoS", "SYN flood", 300), ("Recon", "Port-Scan", 500)):
        write(f"{root}/{kind}/{sub}/x.csv", ["dst_mac,src_mac,f1,f2"] + [f"{MAC[c]},{MAC['d']},{shift + k},{k % 5}" for c in "abc" for k in range(80)] + [f"{MAC['a']},{MAC['d']},oops,1", f"{MAC['a']},{MAC['d']},,1", "ff:ff:ff:ff:ff:ff,x,1,1"])


def first_feature(train, rows, seed):
    return rows.withColumn("score", F.get("z", F.lit(0)))


def test_scans(spark, tmp_path):
    root, path = str(tmp_path / "data"), str(tmp_path / "out")
    tree(root)
    names = {r["file"].rpartition("/")[2]: r["names"] for r in captures.headers(spark, f"{root}/Benign").collect()}
    assert names["b1.csv"] == ["odd", "f2", "note", "f1", "dst_mac", "src_mac"] and len(names) == 3
    loose = captures.loose_rows(spark, root, ["f1"])
    assert loose.count() == captures.typed_rows(spark, root).count() == 900 + 3 + 2 * 243 and all(set(r["values"]) == {"f1"} for r in loose.collect())
    assert external.manifest(spark, root, "Benign", list(MAC), 0.95) == ["extra", "f1", "f2"]
    # Rows of files without a column of the manifest are not complete.
    with pytest.raises(ValueError, match="rows of eligible"):
        external.replicate(spark, root, path, first_feature, {"b": 0.01}, [0], parsed=0.95, min_rows=10)


def test_replication_with_columns_that_all_have(spark, tmp_path):
    root, path = str(tmp_path / "data"), str(tmp_path / "out")
    tree(root)
    budgets = {"b1": 0.01, "b2": 0.04}
    run = lambda **more: external.replicate(spark, root, path, first_feature, budgets, [0, 1], excluded=["extra"], parsed=0.95, min_client=30, min_rows=10, **more)
    out = run()
    assert out == {"devices": 3, "level": "CONFIRMATORY", "columns": ["f1", "f2"], "dropped": 4, "seeds": {0: "WRITTEN", 1: "WRITTEN"}, "worst_fallback": 0.0, "supportive": False}
    scores = timed.scores_of(spark, path, "external", 1)
    got = {(r["client_id"], r["split"], r["attack_subtype"]): r["count"] for r in scores.groupBy("client_id", "split", "attack_subtype").count().collect()}
    assert got == {(MAC[c], s, k): n for c in "abc" for s, k, n in [("benign_frontier", None, 60), ("benign_final_cal", None, 30), ("benign_test", None, 60), *((s, k, n) for k in ("syn_flood", "port_scan") for s, n in (("attack_validation", 16), ("attack_test", 64)))]}
    # Benign rows in the order of files and rows: training rows are those of the first file.
    train = commits.current(spark, timed.place(path, "external", 0))["scores"].where("split = 'benign_train'")
    assert {r["source_file"].rpartition("/")[2] for r in train.select("source_file").distinct().collect()} == {"b0.csv"}
    evals = tables.read_evaluations(spark, f"{path}/run")
    assert {(r["seed"], r["budget_id"]) for r in evals.select("seed", "budget_id").distinct().collect()} == {(s, b) for s in (0, 1) for b in budgets}
    recall = {(r["seed"], r["budget_id"]): r["macro_recall"] for r in evals.where("policy = 'macro'").collect()}
    assert recall[0, "b2"] == recall[1, "b2"] == 1.0
    again = run(max_fallback=-1.0)
    assert again["seeds"] == {0: "REUSED", 1: "REUSED"} and again["supportive"] is True


def test_too_few_devices_end_the_run(spark, tmp_path):
    root, path = str(tmp_path / "data"), str(tmp_path / "out")
    tree(root)
    assert external.replicate(spark, root, path, first_feature, {"b": 0.01}, [0], min_devices=4) == {"devices": 3, "level": "SUPPORTIVE"}
    assert not os.path.exists(path)
    with pytest.raises(ValueError, match="holds numbers"):
        external.manifest(spark, root, "Benign", ["f1", "f2", "extra"], 0.95)


def test_lines_are_read_once_and_not_moved(spark, tmp_path):
    root = str(tmp_path / "data")
    write(f"{root}/Benign/a.csv", ["f1,src_mac,note,f2", '1,a,"x, y",', "2,b", " ,c,z,4,5", '"",d,,"6"'])
    write(f"{root}/Benign/b.csv", ["src_mac,f2", "e,7"])
    rows = captures.typed_rows(spark, root, columns=["f1", "f2", "src_mac"])
    got = {(r["file"][-5:], r["source_row"]): r["values"] for r in rows.collect()}
    one = lambda f1, mac, f2: {"f1": f1, "src_mac": mac, "f2": f2}
    assert got == {("a.csv", 0): one("1", "a", None), ("a.csv", 1): one("2", "b", None), ("a.csv", 2): one(None, "c", "4"), ("a.csv", 3): one(None, "d", "6"), ("b.csv", 0): {"src_mac": "e", "f2": "7"}}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert all(x not in plan for x in ("Window", "SortMergeJoin", "hashpartitioning", "FileScan text")), plan
    # Every pass reads what was scanned; what is known of a file is not worked out for its lines.
    read = external.scanned(spark, root, "Benign")
    assert read.files.columns == ["file", "names", "label", "attack_subtype"]
    plan = captures.loose_rows(spark, root, ["src_mac"], read).where(F.col("label") == "benign")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "regexp_replace(file" not in plan
