"""op6 against brute force over all pairs."""

import numpy as np
import pytest

from fleetward.llm import jaccard_join
from fleetward.llm.jaccard_join import Forest, _overlaps, shingle_set


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(300)]
    text = lambda n: [vocab[i] for i in rng.integers(0, 300, n)]
    out = []
    for _ in range(12):
        base = text(int(rng.integers(20, 120)))
        out.append(base)
        for _ in range(int(rng.integers(0, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, len(copy)))] = "edit" + str(rng.integers(0, 9))
            out.append(copy + text(int(rng.integers(0, 3))))
    texts = [" ".join(x) for x in out]
    return [*texts, texts[0], texts[0], texts[5].replace(" ", "\n"), None, "", " ", "one two", "one  two", "same " * 50, "same " * 60]


@pytest.mark.parametrize("seed,leaf,block", [(0, 256, 256), (1, 3, 4), (2, 1000, 2)])
def test_links(spark, seed, leaf, block):
    texts = corpus(seed)
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[1], (None, "lonely words of a null id here")], "doc_id long, text string").repartition(4)
    got = jaccard_join.join(df, leaf=leaf, block=block).collect()
    assert len(got) == len(rows) + 2
    sets = {k: frozenset(shingle_set(t).tolist()) for k, t in rows}
    classes = {}
    for k, s in sets.items():
        classes.setdefault(s, []).append(k)
    reps = {min(v): s for s, v in classes.items() if s}
    linked = {a: {b for b, t in reps.items() if b != a and len(s & t) >= 0.8 * len(s | t) - 1e-9} for a, s in reps.items()}
    group = {}
    for a in sorted(reps):
        if a not in group:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = a
                    todo += linked[x]
    for r in got:
        k = r["doc_id"]
        if k is None or not sets[k]:
            assert r["n_links"] == 0 and r["class_id"] == k and not r["grouped"]
            continue
        c = min(classes[sets[k]])
        again = sum(x in classes[sets[k]] for x in (1,))
        assert (r["class_id"], r["n_copies"], r["n_links"], r["group_id"]) == (c, len(classes[sets[k]]) + again, len(linked[c]), group[c])


def test_ids_beside_null(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b c d e f"), (None, "d e f"), (big + 2, "a b c d e f")], "doc_id long, text string").coalesce(1)
    assert sorted(((r["doc_id"], r["class_id"]) for r in jaccard_join.join(df).collect()), key=str) == sorted([(big, big), (None, None), (big + 2, big)], key=str)
    assert {r["doc_id"] for r in jaccard_join.keep_one(df).collect()} == {big, None}


def test_very_long_text(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 1 << 30, 150_000)]
    edited = [*words[:70_000], *words[70_100:]]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(edited)), (2, " ".join(words[:90_000]))], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_links"], r["group_id"]) for r in jaccard_join.join(df).collect()} == {0: (1, 0), 1: (1, 0), 2: (0, 2)}


def test_keep_one(spark):
    texts = corpus(3)
    rows = [(k, t, k % 3, "x") for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, sk int, h1 string")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    groups = {r["doc_id"]: r["group_id"] for r in jaccard_join.join(df).collect()}
    empty = [k for k, t in enumerate(texts) if not (t or "").split()]
    want = sorted({g for k, g in groups.items() if k not in empty}) + empty
    assert ids == sorted(want)


def test_overlaps_and_forest():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(9)]
    got = _overlaps(sets)
    for a in range(9):
        for b in range(9):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))
    f = Forest(6)
    f.add(0, np.array([3]))
    f.add(4, np.array([5]))
    f.add(3, np.array([5]))
    node, root = f.edges()
    assert node.tolist() == [0, 3, 4, 5] and root.tolist() == [0, 0, 0, 0]


def test_components_over_long_paths(spark):
    from fleetward.llm.graph import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(df).count() == 0 and jaccard_join.keep_one(df).count() == 0
