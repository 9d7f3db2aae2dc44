import os

import pytest
from pyspark.sql import functions as F

from fleetward.operators import events
from fleetward.sources import captures
from fleetward.streaming.sessions import alert_sessions


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_packet_collection(spark, tmp_path):
    root = str(tmp_path)
    _write(f"{root}/BenignTraffic/a.csv", ["device_mac,dst_mac,f1,f2,junk", " AA (x) ,z,1,2,q", "aa (x),z,3,oops,q", "aa (x),z,4,5,q"])
    _write(f"{root}/DDoS/Syn Flood!/b.csv", ["device_mac,dst_mac,f1,f2,junk", "z,AA (x),7,8,q", "z,33:33:00:00:00:01,7,8,q", "z,,7,8,q"])
    _write(f"{root}/stray.csv", ["device_mac,dst_mac,f1,f2,junk", "z,AA (x),7,8,q"])
    rows = captures.classify(captures.typed_rows(spark, root), root, "BenignTraffic")
    manifest = {r["column"]: (r["rows"], r["numeric"]) for r in captures.feature_manifest(rows, ["device_mac", "dst_mac"], 0.5).collect()}
    assert manifest == {"f1": (6, 6), "f2": (6, 5)}
    got = captures.packet_rows(rows, "device_mac", "dst_mac", ["f1", "f2"])
    kept = sorted((r["client_id"], r["label"], r["attack_subtype"], r["source_row"], tuple(r["x"])) for r in got.where("complete").collect())
    assert kept == [("aa _x_", "attack", "syn_flood", 0, (7.0, 8.0)), ("aa _x_", "benign", None, 0, (1.0, 2.0)), ("aa _x_", "benign", None, 2, (4.0, 5.0))]
    assert got.where("not complete").count() == 1
    c = captures.census(got).first()
    assert (c["benign"], c["attack"], c["subtypes"]) == (3, 1, 1)
    level = captures.evidence_level(captures.census(got), 2, 1, 1).first()
    assert (level["devices"], level["level"]) == (1, "CONFIRMATORY")
    assert captures.header(spark, f"{root}/stray.csv") == ["device_mac", "dst_mac", "f1", "f2", "junk"]


def test_timed_capture_audit(spark, tmp_path):
    root = str(tmp_path)
    benign = [f'dev{k % 2},Benign,"Jan 14, 2020 00:00:{k:02d}.000000000 GMT",1' for k in range(20)]
    attack = [f'dev{k % 2},Port Scan,"Jan 18, 2020 00:00:{k:02d}.000000000 GMT",1' for k in range(20)]
    _write(f"{root}/x.csv", ["eth.src,label,frame.time,f1", *attack, *benign])
    rows = captures.timed_rows(captures.typed_rows(spark, root))
    assert {r["attack_subtype"] for r in rows.where("label = 'attack'").collect()} == {"port-scan"}
    audit = events.capture_audit(rows, 3600.0)
    one = audit.first()
    assert (one["devices"], one["parsed_share"], one["associable"], one["has_attack"], one["out_of_order"], one["separable"]) == (2, 1.0, 1.0, True, 0.0, True)
    assert captures.gate(audit).first()["status"] == "PASS"
    assert captures.gate(audit.limit(0)).first()["status"] == "FAIL"
    mixed = rows.where("label = 'attack' or ordinal % 2 = 0").withColumn("t", F.when(F.col("label") == "benign", F.lit(1579305605.0)).otherwise(F.col("t")))
    assert captures.gate(events.capture_audit(mixed, 3600.0)).first()["separable"] is False


def test_sessions_batch_and_stream(spark, tmp_path):
    times = [0, 5, 9, 12, 100, 103, 400]
    df = spark.createDataFrame([("a", t) for t in times], "client_id string, s long").select("client_id", F.timestamp_seconds("s").alias("ts"))
    want = {(0, 12, 4), (100, 103, 2), (400, 400, 1)}
    show = lambda rows: {(int(r["start"].timestamp()), int(r["end"].timestamp()), r["alarms"]) for r in rows}
    assert show(alert_sessions(df, 5, 10).collect()) == want
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = alert_sessions(stream, 5, 10).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    # The last session waits for the watermark.
    assert show(spark.table("sessions").collect()) == want - {(400, 400, 1)}


def test_score_tables(spark, tmp_path):
    from fleetward.operators import checks
    from fleetward.sources import tables

    rows = [("f", k, float(k), "benign", None, None, "d", 1, "ab"[k % 2], "benign_test" if k % 3 else "benign_train") for k in range(20)]
    df = spark.createDataFrame(rows, "source_file string, source_row long, score double, label string, attack_subtype string, timestamp double, dataset_id string, seed long, client_id string, split string").withColumn("sample_id", tables.sample_id())
    path = str(tmp_path / "scores")
    tables.write_scores(df, path)
    got = tables.read_scores(spark, path, ["sample_id", "score"], client_id="a", split=["benign_test"], seed=1)
    assert sorted(r["score"] for r in got.collect()) == [float(k) for k in range(0, 20, 2) if k % 3]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "client_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert checks.repeated(df, ["sample_id"]).count() == 0 and checks.not_finite(df, ["score"]).count() == 0
    assert checks.not_finite(df.withColumn("score", F.lit(float("inf"))), ["score"]).count() == 20
    again = tables.read_scores(spark, path)
    assert checks.digest(df, ["client_id"], ["sample_id", "score"]).exceptAll(checks.digest(again, ["client_id"], ["sample_id", "score"])).count() == 0


def test_lines_of_many_blocks(spark, tmp_path):
    """A file that Spark deals out in many blocks keeps its lines' places."""
    root = str(tmp_path)
    _write(f"{root}/a.csv", ["f1,f2", *(f"{k},{k * 7}" for k in range(5000))])
    _write(f"{root}/b.csv", ["f2,f1", "1,2", "", "3,4"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = captures.typed_rows(spark, root)
        assert rows.rdd.getNumPartitions() > 0
        got = {(r["file"][-5:], r["source_row"]): r["values"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(got["a.csv", k] == {"f1": str(k), "f2": str(k * 7)} for k in range(5000))
    assert got["b.csv", 0] == {"f2": "1", "f1": "2"} and got["b.csv", 2] == {"f2": "3", "f1": "4"} and len(got) == 5002
    assert captures.typed_rows(spark, root, row_limit=2).count() == 3
    assert [f[-5:] for f in captures.capture_files(spark, root)] == ["a.csv", "b.csv"] and len(captures.capture_files(spark, root, 1)) == 1


def test_device_tree(spark, tmp_path):
    root = str(tmp_path / "data")
    for d in ("door bell", "cam"):
        _write(f"{root}/{d}/benign_traffic.csv", ["f1,f2,f3", *(f"{k},0.5,-{k}" for k in range(20))])
        _write(f"{root}/{d}/gafgyt_attacks/scan.csv", ["f1,f2,f3", *["7,7,7"] * 5])
    _write(f"{root}/cam/mirai_attacks/udpplain.csv", ["f1,f2,f3", *["8,8,8"] * 5])
    _write(f"{root}/cam/mirai_attacks/other.csv", ["f1,f2,f3", "1,1,1"])
    rows = captures.device_tree(spark, root).collect()
    count = {}
    for r in rows:
        key = (r["client_id"], r["label"], r["attack_subtype"], r["source_file"])
        count[key] = count.get(key, 0) + 1
    assert count == {
        ("door bell", "benign", None, "benign_traffic.csv"): 20, ("door bell", "attack", "bashlite_scan", "gafgyt_attacks/scan.csv"): 5,
        ("cam", "benign", None, "benign_traffic.csv"): 20, ("cam", "attack", "bashlite_scan", "gafgyt_attacks/scan.csv"): 5, ("cam", "attack", "mirai_udpplain", "mirai_attacks/udpplain.csv"): 5,
    }
    assert all(r["x"] == [float(r["source_row"]), 0.5, -float(r["source_row"])] for r in rows if r["label"] == "benign")
    assert {r["client_id"] for r in captures.device_tree(spark, root, clients={"cam": "d1"}).collect()} == {"d1"}
    with pytest.raises(ValueError, match="benign_traffic"):
        captures.device_tree(spark, root, clients={"cam": "d1", "none": "d2"})
    _write(f"{root}/fridge/mirai_attacks/ack.csv", ["f1,f2,f3", "1,1,1"])
    with pytest.raises(ValueError, match="fridge"):
        captures.device_tree(spark, root)
    _write(f"{root}/fridge/benign_traffic.csv", ["f1,f2,f3", "1,oops,1"])
    with pytest.raises(Exception, match="no finite number in row 0"):
        captures.device_tree(spark, root).collect()


def test_timed_features(spark, tmp_path):
    root = str(tmp_path)
    head = "eth.src,label,frame.time,f1,note,f2"
    _write(f"{root}/x.csv", [head, "d1,Benign,t,1,n,2", "d1,Benign,t,oops,n,2", " d2 ,Port Scan,t,,n,4", ",Benign,t,1,n,1", "d1,Benign,t,inf,n,1"])
    _write(f"{root}/y.csv", [head, "d1,Benign,t,5,n,6"])
    layout = ["eth.src", "label", "frame.time"]
    names = captures.same_features(spark, captures.capture_files(spark, root), layout, ["note"])
    assert names == ["f1", "f2"]
    got = captures.timed_features(captures.typed_rows(spark, root), names)
    assert sorted((r["client_id"], r["source_file"], r["source_row"], r["label"], r["attack_subtype"], tuple(r["x"])) for r in got.collect()) == [
        ("d1", "x.csv", 0, "benign", None, (1.0, 2.0)), ("d1", "y.csv", 0, "benign", None, (5.0, 6.0)), ("d2", "x.csv", 2, "attack", "port-scan", (0.0, 4.0)),
    ]
    assert {r["client_id"]: r["n_train"] for r in captures.trainable(got).collect()} == {"d1": 1}
    _write(f"{root}/z.csv", ["eth.src,label,frame.time,f1,note", "d1,Benign,t,5,n"])
    with pytest.raises(ValueError, match="z.csv"):
        captures.same_features(spark, captures.capture_files(spark, root), layout, ["note"])
    with pytest.raises(ValueError, match="lacks"):
        captures.same_features(spark, captures.capture_files(spark, root), ["when"])
    assert captures.flow_gate(["f1", "f2"])["passed"] is False and captures.flow_gate(["ts", "src_mac"])["passed"] is True


def test_dropped_and_eligible_rows(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "client_id string, complete boolean")
    assert {r["client_id"]: (r["kept"], r["dropped"]) for r in captures.dropped_rows(df).collect()} == {"a": (1, 1), "b": (1, 0)}
    assert [r["client_id"] for r in captures.eligible_rows(df, df.select("client_id").where("client_id = 'b'")).collect()] == ["b"]
    with pytest.raises(ValueError, match="eligible clients"):
        captures.eligible_rows(df, df.limit(0))
    with pytest.raises(ValueError, match="rows of eligible"):
        captures.eligible_rows(df, spark.createDataFrame([("z",)], "client_id string"))


def test_run_tables(spark, tmp_path):
    from fleetward.sources import tables

    rows = [("ab"[k % 2], ["benign_frontier", "benign_test", "benign_train"][k % 3], "benign", None, k, float(k)) for k in range(18)]
    df = spark.createDataFrame(rows, "client_id string, split string, label string, attack_subtype string, ordinal long, score double")
    records = tables.score_records(df, "d", 3)
    path = str(tmp_path / "scores")
    tables.write_scores(records, path)
    people = df.select("client_id").distinct()
    bundle = tables.seed_bundle(spark, path, "d", 3, people)
    assert bundle.count() == 12 and tables.seed_bundle(spark, path, "d", 3, people, train=True).count() == 18
    assert {(r["client_id"], r["split"], r["source_row"]) for r in bundle.collect()} == {(c, s, k) for c in "ab" for s in ("benign_frontier", "benign_test") for k in range(3)}
    with pytest.raises(ValueError, match="only the left"):
        tables.seed_bundle(spark, path, "d", 3, people.where("client_id = 'a'"))
    tables.write_scores(records, str(tmp_path / "twice"))
    records.where("split = 'benign_test'").write.mode("append").partitionBy(*tables.PARTITIONS).parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="2 rows have the key"):
        tables.seed_bundle(spark, str(tmp_path / "twice"), "d", 3, people)
    evals = spark.createDataFrame([(2, "b1", "p", 0.5), (1, "b2", "p", 0.25)], "seed long, budget_id string, policy string, macro_recall double")
    tables.persist_run(evals, evals, evals.limit(0), str(tmp_path / "run"))
    assert [(r["seed"], r["budget_id"], r["macro_recall"]) for r in tables.read_evaluations(spark, str(tmp_path / "run")).collect()] == [(1, "b2", 0.25), (2, "b1", 0.5)]
    with pytest.raises(ValueError, match="no allocations"):
        tables.read_run(spark, str(tmp_path / "run"), "allocations")
    tables.persist_run(evals.limit(0), evals.where("seed = 1").withColumn("macro_recall", F.lit(0.75)), evals.limit(0), str(tmp_path / "run"))
    assert [r["macro_recall"] for r in tables.read_evaluations(spark, str(tmp_path / "run")).collect()] == [0.75, 0.5]
    with pytest.raises(ValueError, match="no rows"):
        tables.write_rows(evals.limit(0), str(tmp_path / "none"))
    tables.write_csv(evals.orderBy("seed"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    stats = spark.createDataFrame([("a", 0, 1.0, 2.0)], "client_id string, feature int, mean double, sd double")
    tables.write_scaler(stats, str(tmp_path / "scaler"))
    assert tables.read_scaler(spark, str(tmp_path / "scaler")).collect() == stats.collect()
