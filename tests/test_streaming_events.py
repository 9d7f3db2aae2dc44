"""Events of a stream against those of the whole table, over batches, disorder, late rows and a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetward.operators import events
from fleetward.streaming.events import Settled, alert_events

PARAMETERS = (2.0, 5.0, 3.0, 20.0)


@pytest.mark.parametrize("seed", range(20))
def test_machine_equals_whole_runs(seed):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, [40, 200, 1000][seed % 3], 50).astype(float))
    parameters = (0.0, float(rng.choice([0, 3, 8])), float(rng.choice([0, 2, 6])), float(rng.choice([0, 10, 40])))
    m = Settled(parameters)
    for k, x in enumerate(t):
        m.alert(float(x))
        if rng.random() < 0.5:
            m.clock(float(x) if k + 1 == len(t) or t[k + 1] > x else float(x))
    m.clock(1e9)
    blocks = np.split(t, np.flatnonzero(np.diff(t) > parameters[1]) + 1)
    want = []
    for b in blocks:
        if b[-1] - b[0] < parameters[2]:
            continue
        if want and b[0] - want[-1][1] < parameters[3]:
            want[-1] = (want[-1][0], b[-1], want[-1][2] + len(b))
        else:
            want.append((b[0], b[-1], len(b)))
    assert m.out == want


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_stream_equals_batch_and_survives_a_restart(rocks, tmp_path):
    spark, rng = rocks, np.random.default_rng(3)
    rows = []
    for c, n in (("a", 240), ("b", 120), ("quiet", 30)):
        t = np.sort(rng.integers(0, 900, n)).astype(float)
        rows += [(c, float(x), bool(rng.random() < (0.6 if c != "quiet" else 0)), float(x + rng.uniform(0, 8))) for x in t]
        rows.append((c, 5000.0, False, 5000.0))
    # Arrival is up to 8 s behind; four files in order of arrival, the last with the clock's rows and two late alerts.
    arrival = np.array([r[3] for r in rows])
    parts = np.searchsorted([220, 450, 700], arrival)
    late = [("a", 1.0, True, 0.0), ("a", 2.0, True, 0.0), (None, None, True, 0.0)]
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def put(k):
        own = [r[:3] for r, p in zip(rows, parts, strict=True) if p == k] + [r[:3] for r in late if k == 2]
        spark.createDataFrame([own[i] for i in rng.permutation(len(own))], "client_id string, t double, alert boolean").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("client_id string, t double, alert boolean").option("maxFilesPerTrigger", 1).parquet(source)
        q = alert_events(stream, 10.0, PARAMETERS).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    put(0)
    put(1)
    run()
    first = spark.read.parquet(out).count()
    put(2)
    put(3)
    run()  # another query, from the checkpoint
    got = spark.read.parquet(out)
    alerts = spark.createDataFrame([r[:2] for r in rows if r[2]], "client_id string, t double")
    want = events.eventize(alerts, ["client_id"], *PARAMETERS)
    tell = lambda df: sorted((r["client_id"], r["start"], r["end"], r["alarms"]) for r in df.collect())
    assert tell(got.where("kind = 'event'")) == tell(want) and 0 < first < got.count()
    assert [(r["client_id"], r["alarms"]) for r in got.where("kind = 'late'").collect()] == [("a", 2)]
    assert got.where(F.col("client_id") == "quiet").count() == 0
