"""op4 and op7 against brute force, with small windows, ties, copies, hot grams and very long texts."""

import hashlib
from dataclasses import replace

import numpy as np
import pytest

from fleetward.llm import dupscan, substring_dedup, suffix_dedup
from fleetward.llm.tokens import window_hashes


def covered(seqs, w):
    seen = {}
    for k, s in enumerate(seqs):
        for i in range(len(s) - w + 1):
            seen.setdefault(tuple(s[i : i + w]), []).append((k, i))
    out = [np.zeros(len(s), dtype=bool) for s in seqs]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                out[k][i : i + w] = True
    return out


def corpus(seed, n=40):
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join("".join(rng.choice(list("abc"), rng.integers(1, 3))) for _ in range(k))
    shared = [word(30) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [word(int(rng.integers(0, 25)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(0, 4))], word(int(rng.integers(0, 9)))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], texts[1] + " x", None, "", "  \n\t ", "x y " * 80, "é ü " * 40, shared[0] + "\n" + shared[0], "aaaa" * 50]
    return texts


def frame(spark, texts):
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, texts[2], "c")], "doc_id long, text string, gram string").repartition(5)


def words(t):
    return [x for x in (t or "").replace("\x0b", " ").split() if x]


@pytest.mark.parametrize("seed,limit", [(0, 20000), (1, 2), (2, 6), (3, 20)])
def test_words(spark, seed, limit):
    df = frame(spark, corpus(seed))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    gone = covered([words(t) for _, t in rows], 12)
    want = sorted((d is None, d or 0, len(g), int(g.sum()), hashlib.sha256(" ".join(np.array(words(t), dtype=object)[~g]).encode()).hexdigest()) for (d, t), g in zip(rows, gone, strict=True))
    got = substring_dedup.remove_repeats(df, 12, 4, group_limit=limit).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("seed,limit", [(4, 20000), (5, 2), (6, 6), (7, 20)])
def test_bytes(spark, seed, limit):
    df = frame(spark, corpus(seed))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    data = [(t or "").encode() for _, t in rows]
    gone = covered(data, 24)
    want = sorted((d is None, d or 0, len(b), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~g].tobytes()).hexdigest()) for (d, _), b, g in zip(rows, data, gone, strict=True))
    got = suffix_dedup.remove_repeats(df, 24, 8, group_limit=limit).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_pieces_of_long_texts(monkeypatch):
    rng = np.random.default_rng(0)
    kind = suffix_dedup.byte_kind(40, 16)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (500, 39, 40, 0, 1200)]
    whole = sorted(zip(*dupscan.select_anchors(kind, texts), strict=True))
    starts = {(t, p) for t, _, lo, hi, _ in whole for p in range(lo, hi + 1)}
    assert starts == {(k, p) for k, x in enumerate(texts) for p in range(len(x) - 39)}
    monkeypatch.setattr(dupscan, "PIECE", 64)
    cut = {(t, q, p) for t, q, lo, hi, _ in zip(*dupscan.select_anchors(kind, texts), strict=True) for p in range(lo, hi + 1)}
    assert cut == {(t, q, p) for t, q, lo, hi, _ in whole for p in range(lo, hi + 1)}


def test_pieces_change_nothing(spark, monkeypatch):
    """Texts of many pieces against brute force: an anchor at a border is one place, not two."""
    words_of, bytes_of = substring_dedup.word_kind, suffix_dedup.byte_kind
    monkeypatch.setattr(substring_dedup, "word_kind", lambda w, g: replace(words_of(w, g), piece=30))
    monkeypatch.setattr(suffix_dedup, "byte_kind", lambda w, g: replace(bytes_of(w, g), piece=64))
    rng = np.random.default_rng(8)
    unique = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 400)) for _ in range(3)]
    texts = [*corpus(8, 10), *unique, unique[0][:3000] + " then " + unique[1][:900]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    gone = covered([words(t) for t in texts], 12)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df, 12, 4).collect()}
    assert got == {k: int(g.sum()) for k, g in enumerate(gone)}
    gone = covered([(t or "").encode() for t in texts], 24)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df, 24, 8).collect()}
    assert got == {k: int(g.sum()) for k, g in enumerate(gone)}


@pytest.mark.parametrize("weak", [False, True])
def test_suffix_sort(monkeypatch, weak):
    """Also with hashes that are all alike: the order is then put right by the bytes."""
    if weak:
        monkeypatch.setattr(suffix_dedup, "byte_symbols", lambda x: np.zeros(x.shape, dtype=np.uint64))
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (60, 26)).astype(np.int16)
    right = rng.integers(1, 26, 60)
    order, common = suffix_dedup.Suffixes(x, right).neighbours(np.array([0, 7, 40]), np.array([7, 33, 20]))
    for a, b in ((0, 7), (7, 40), (40, 60)):
        assert sorted(order[a:b]) == list(range(a, b)) and common[a] == -1
        keys = [(x[i, : right[i]].tolist(), i) for i in order[a:b]]
        assert keys == sorted(keys)
        for (p, _), (q, _), n in zip(keys, keys[1:], common[a + 1 : b], strict=False):
            assert p[:n] == q[:n] and (n == min(len(p), len(q)) or p[n] != q[n])


def occurrences(kind, seqs, encode):
    """All windows of some sequences by their selectors, as decide() takes them."""
    rows = []
    for k, (numbers, n) in enumerate(seqs):
        for _, pos, lo, hi, gram in zip(*dupscan.select_anchors(kind, [numbers]), strict=True):
            left = min(pos, kind.left)
            rows.append((gram, encode(k, pos - left, min(pos + kind.window, n)), left, pos - hi, pos - lo, k, pos))
    rows.sort(key=lambda r: (r[0], r[5], r[6]))
    return rows


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("which", ["words", "bytes"])
def test_decide_any_number_of_surroundings(monkeypatch, which, weak):
    """Thousands of different surroundings of one gram in one task, against brute force; also with useless hashes."""
    rng = np.random.default_rng(5)
    n = 400 if weak else 4000
    shared = "s1 s2 s3 s4 s5 s6"
    texts = [" ".join([*rng.choice(["p", "q", "r", "u"], int(rng.integers(0, 9))), shared, *rng.choice(["p", "q", "r", "u"], int(rng.integers(4, 9)))]) for _ in range(n)]
    if which == "words":
        kind = substring_dedup.word_kind(12, 4)
        seqs = [t.split() for t in texts]
        symbols = [kind.symbols(t) for t in texts]
        rows = occurrences(kind, [(kind.numbers(t), len(s)) for t, s in zip(texts, seqs, strict=True)], lambda k, a, b: symbols[k](a, b))
    else:
        kind = suffix_dedup.byte_kind(24, 8)
        seqs = [t.encode() for t in texts]
        rows = occurrences(kind, [(kind.numbers(t), len(s)) for t, s in zip(texts, seqs, strict=True)], lambda k, a, b: seqs[k][a:b])
    if weak:
        monkeypatch.setattr(substring_dedup, "mix", lambda x: np.zeros(x.shape, dtype=np.uint64))
        monkeypatch.setattr(substring_dedup, "word_hashes", lambda d, s, e: np.zeros(len(s), dtype=np.uint64))
        monkeypatch.setattr(suffix_dedup, "byte_symbols", lambda x: np.zeros(x.shape, dtype=np.uint64))
    gram, around, n_left, t_min, t_max, text, pos = (list(x) for x in zip(*rows, strict=True))
    assert weak or max(np.unique(gram, return_counts=True)[1]) > 1000
    got = set()
    for row, first, last in zip(*dupscan.decide(kind, np.array(gram), around, np.array(n_left), np.array(t_min), np.array(t_max)), strict=True):
        got |= {(text[row], pos[row] - t) for t in range(first, last + 1)}
    seen = {}
    for k, s in enumerate(seqs):
        for i in range(len(s) - kind.window + 1):
            seen.setdefault(tuple(s[i : i + kind.window]), []).append((k, i))
    assert got == {p for places in seen.values() if len(places) > 1 for p in places}


def test_factors_are_greedy():
    """A block's factors: the longest run of words it has in common with another block, then on at the boundary."""
    kind = substring_dedup.word_kind(4, 2)
    around = [b"a b g h c d", b"x b g h c y", b"a b g h z z"]
    g = dupscan.Group(kind, np.zeros(3, dtype=np.int64), around, np.full(3, 2), np.zeros(3, dtype=np.int64), np.full(3, 2))
    blocks = substring_dedup.Blocks(g)
    assert blocks.longest(np.arange(3), 0).tolist() == [4, 0, 4]
    assert blocks.longest(np.arange(3), 1).tolist() == [4, 4, 0]
    assert substring_dedup.factor(g).tolist() == [[False, True, True], [False, True, False], [False, False, True]]


def test_ids_beside_null(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b c"), (None, "d e f")], "doc_id long, text string").coalesce(1)
    for out in (substring_dedup.remove_repeats(df), suffix_dedup.remove_repeats(df)):
        assert {r["doc_id"] for r in out.collect()} == {big, None}


def test_shuffled_where_nothing_may_be_broadcast(spark, monkeypatch):
    """The same rows when no side of a join is small enough to broadcast."""
    from fleetward.llm import common

    df = frame(spark, corpus(9))
    want = sorted(map(str, substring_dedup.remove_repeats(df, 12, 4, group_limit=6).collect()))
    monkeypatch.setattr(common.small_side, "__defaults__", (-1,))
    assert sorted(map(str, substring_dedup.remove_repeats(df, 12, 4, group_limit=6).collect())) == want


def test_window_hashes_depend_on_content_alone():
    x = np.arange(50, dtype=np.uint64) % np.uint64(7)
    for k in (1, 2, 5, 8, 13):
        for mixed in (True, False):
            h = window_hashes(x, k, mixed)
            assert len(h) == 50 - k + 1
            same = {tuple(x[i : i + k]): h[i] for i in range(len(h))}
            assert all(same[tuple(x[i : i + k])] == h[i] for i in range(len(h))) and len(set(same.values())) == len(same)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(df).count() == 0
    assert suffix_dedup.remove_repeats(df).count() == 0
