"""op3 against brute force over all windows."""

import re
from collections import Counter

import numpy as np
import pytest

from fleetward.llm import decontaminate


def words(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def grams(t):
    w = words(t)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    out = {}
    for d, t in docs:
        g = grams(t)
        for i, it in items:
            c = Counter(grams(it))
            n = sum(c.values())
            if not n:
                whole, own = words(it), words(t)
                if whole and any(own[s : s + len(whole)] == whole for s in range(len(own))):
                    out[d, i] = 1.0
                continue
            best = 0.0
            for s in range(len(g)):
                a = Counter(g[s : s + n])
                best = max(best, sum((a & c).values()) / sum((a | c).values()))
            if best >= 0.8 - 1e-12:
                out[d, i] = max(out.get((d, i), 0), round(best, 6))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"v{k}" for k in range(60)]
    text = lambda n: " ".join(vocab[i] for i in rng.integers(0, 60, n))
    items = [text(int(rng.integers(12, 70))) for _ in range(12)] + ["too short", None, "", "a b c d e a b c d e a b c d e f"]
    docs = []
    for k in range(40):
        body = words(items[int(rng.integers(0, 12))])
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(body)))
            body = body[:at] + ["edit"] * int(rng.integers(0, 2)) + body[at + 1 :]
        cut = int(rng.integers(0, 3)) * (k % 3 == 0)
        docs.append(f"{text(int(rng.integers(0, 30)))} {' '.join(body[cut:]).title()}, {text(int(rng.integers(0, 30)))}" if k % 4 else text(50))
    docs += [None, "", "  ", items[15].upper() + "!", items[0], items[0] + "\n" + items[1] + " " + items[0], docs[1], "v1 " * 4000 + items[2], "This is: Too SHORT, so.", "too, but not short"]
    return list(enumerate(docs)), list(enumerate(items))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs] + [(docs[5][0], docs[5][1], 1)], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(df, bench).collect()}
    want = brute(docs, items)
    # The sketch may lose a pair at the threshold; none below it may come.
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert {k for k, s in want.items() if s > 0.83} <= set(got) and len(got) >= 0.97 * len(want)
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d in [*(x for x, _ in docs), docs[5][0]] if d not in {k for k, _ in got})


def test_position_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "x, y z The Quick brown fox jumps over the lazy dog today again z")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the quick brown fox jumps over the lazy dog today again")], "item_id long, text string")
    r = decontaminate.matches(df, bench).first()
    assert (r["doc_id"], r["item_id"], r["similarity"], r["start"], r["n_words"]) == (None, 7, 1.0, 3, 11)
    assert decontaminate.matches(df.limit(0), bench).count() == 0
    assert decontaminate.matches(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, bench).count() == 0 and decontaminate.drop_contaminated(df, bench.limit(0)).count() == 1
