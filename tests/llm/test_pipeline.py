"""The pipeline's stages against what their operators decide, each on its own input."""

import os
import re

import pytest

import corpus_pipeline
from fleetward.llm import decontaminate, jaccard_join, mixing, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (docs, out))
        assert set(after) <= set(before) and (k == 4 or out.columns == columns)
        if k == 0:
            assert set(after) == {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
        if k == 1:
            groups = {r["doc_id"]: r["group_id"] for r in jaccard_join.join(docs).collect()}
            assert sorted(after) == sorted(set(groups.values()))
        if k == 2:
            bad = {r["doc_id"] for r in decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - bad and bad
        if k == 3:
            assert set(after) == set(before)
            for d, t in after.items():
                assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)
                assert "<" in t or t == before[d]
        if k == 4:
            want = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs).collect()}
            got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
            assert got == {d: n for d, n in want.items() if n}
        seen.append(name)
        docs = out
    assert len(seen) == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-1] == "copy" and 0 < out.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, h1 string, copies string, `a.b` int"


def _odd_documents(spark):
    big = (1 << 60) + 1
    prose = lambda k: " ".join(f"the alpha{i}q{k} beta{i} of gamma{i} delta{i}" for i in range(1, 30)) + "."
    rows = [(big + k, prose(k + 1), "en", None if k % 3 else "s", None, "r", "t", "h", "c", k) for k in range(12)]
    rows += [rows[0], (None, prose(40), "en", "s", 1, None, None, None, None, None), (big + 50, None, None, None, None, "r", "t", "h", "c", 0), (big + 51, "", "", "", 0, "r", "t", "h", "c", 0), (big + 52, prose(1) + " tail", "en", "s", 3, "r", "t", "h", "c", 0)]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    """Nulls everywhere, ids beyond a double beside a null, repeated rows, columns with the operators' own names."""
    docs = _odd_documents(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    rows = out.collect()
    known = {(r["doc_id"], r["row"], r["t"], r["h1"], r["copies"], r["a.b"]) for r in docs.collect()}
    assert {(r["doc_id"], r["row"], r["t"], r["h1"], r["copies"], r["a.b"]) for r in rows} <= known
    assert any(r["doc_id"] is None for r in rows) or k == 4
    empty = corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF)
    assert empty.columns[: len(docs.columns)] == docs.columns and empty.count() == 0


def test_released_tables_are_gone(spark):
    import glob

    from fleetward.llm import common

    with common.released(spark):
        df = common.stage(spark.range(5), "to-go")
        assert df.count() == 5
        assert glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/to-go-*")
    assert not glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/to-go-*")
