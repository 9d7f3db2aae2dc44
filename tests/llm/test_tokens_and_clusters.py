"""op11 and op13 against plain versions: whole encodings, bit by bit packing, full scans."""

import io
import os
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from parity import assert_same, by_sql

from fleetward.llm import token_files, yinyang
from fleetward.llm.common import new_path, released, stage
from fleetward.llm.queries import op11_token_bit_packing, op13_yinyang_clusters

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_bits(ids, width):
    n = sum(int(x) << (k * width) for k, x in enumerate(ids))
    return n.to_bytes(-(-len(ids) * width // 8), "little")


@pytest.mark.parametrize("width", [1, 3, 8, 13, 15, 16, 17, 24, 31, 32])
def test_packing_is_bit_by_bit(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 203, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, width)
    assert data == plain_bits(ids, width)
    assert (token_files.unpack(data, len(ids), width) == ids).all()


def test_width():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


class Kept(io.BytesIO):
    def close(self):
        self.data = self.getvalue()
        super().close()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.integers(2, 70_000), st.sampled_from([8, 16, 64]))
def test_file_round_trip(sizes, vocab, block):
    rng = np.random.default_rng(len(sizes))
    docs = [rng.integers(0, vocab, n).astype(np.uint32) for n in sizes]
    out = Kept()
    w = token_files.Writer(out, vocab, block)
    places = [w.add(d) for d in docs]
    w.close()
    r = token_files.Reader(io.BytesIO(out.data))
    everything = np.concatenate([np.empty(0, np.uint32), *docs])
    assert r.n == len(everything) and r.docs == len(docs)
    for k, d in enumerate(docs):
        assert (r.document(k) == d).all() and places[k] == (sum(sizes[:k]), len(d))
    for a in range(0, r.n + 1, 7):
        assert (r.ids(a, min(13, r.n - a)) == everything[a : a + 13]).all()
    with pytest.raises(IndexError):
        r.ids(r.n, 1)


def test_broken_file_and_foreign_id():
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(b"x" * 64))
    with pytest.raises(ValueError):
        token_files.Writer(Kept(), 10).add(np.array([10], dtype=np.uint32))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "it's", "don't", "42", "é", "中文", "😀", "<|endoftext|>", ".", "...", "A b", "​", "'"]), max_size=14).map("".join))
def test_pieces_are_as_whole_texts(text):
    whole = token_files.encoder(BPE)._raw([text])[0]
    assert token_files.encoder(BPE).encode([text]) == [whole]


def test_words_of_every_latin_character():
    rng = np.random.default_rng(1)
    signs = np.array([*map(chr, range(0x250)), *" '\n" * 60, *"stmdrevl" * 20, *"中’\u2003\u3000😀\u0301\x85" * 6])
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(3_000)]
    e = token_files.Encoder(BPE)
    assert e.encode(texts) == e._raw(texts) and e.encode([]) == [] and e.encode(["", ""]) == [b"", b""]


def test_words_are_remembered_in_little_memory_and_long_texts_go_by_parts(monkeypatch):
    e = token_files.Encoder(BPE)
    names = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) for k in range(60_000)]
    text = " ".join(f"{w}.\n{w.upper()}" for w in names)
    whole = e._raw([text])
    e.encode(["a"])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    assert e.encode([text]) == whole
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    # 120,000 different words; pieces of text are not remembered beside them.
    assert held < 20 << 20, held
    monkeypatch.setattr(token_files, "SLICE_CHARS", 1_000)
    monkeypatch.setattr(token_files, "REMEMBERED", 5_000)
    assert e.encode([text]) == whole
    assert len(e.words) < 7_000


def test_other_tokenizers_get_whole_texts():
    e = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not e.cuts
    assert e.encode(["Two  words"]) == [np.array(e.tokenizer.encode("Two  words", add_special_tokens=False).ids, dtype="<u4").tobytes()]


def want_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_odd_documents(spark, monkeypatch):
    rows = [(5, "b a"), (None, "null id"), (3, None), (4, ""), (7, "x" * 30_000), (6, "word " * 20_000), (8, "\n \n"), (-2, "<|endoftext|> is text"), (9, "same"), (9, "same"), (10, " ")]
    docs = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, row int, file string")
    folder = new_path(spark, "t")
    token_files.write(docs, BPE, folder, 2, block=64)
    want = want_tokens(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    got = sorted(map(tuple, token_files.digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    read = {r["start"]: r for r in token_files.read(spark, folder).collect()}
    for doc, start, n, crc in want:
        assert (read[start]["doc_id"], read[start]["n_tokens"]) == (doc, n)
        assert zlib.crc32(np.array(read[start]["ids"], dtype="<u4").tobytes()) == crc
    monkeypatch.setattr(token_files, "CHUNK", 1000)
    index = token_files.index(spark, folder).select("doc_id", "file", "first", "n_tokens", "start").toArrow().to_batches()
    parts = list(token_files._reading(folder, False)(iter(index)))
    assert len(parts) == 4 and sorted((tuple(r.values()) for b in parts for r in b.to_pylist()), key=lambda r: r[1]) == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = new_path(spark, "t")
    token_files.write(docs, BPE, folder, 2)
    assert token_files.read(spark, folder).collect() == [] and token_files.digests(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_files_of_failed_attempts_go(spark):
    folder = new_path(spark, "t")
    token_files.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), BPE, folder, 2)
    left = f"{folder}/ids-000000-9-left.bits"
    with open(left, "wb") as f:
        f.write(b"half a file")
    token_files._tidy(spark, folder)
    assert not os.path.exists(left) and sum(x.endswith(".bits") for x in os.listdir(folder)) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_whole_table(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    assert sorted(map(tuple, op11_token_bit_packing(spark, SF).collect())) == want_tokens(rows)


def brute(vectors, k, rounds):
    from hashlib import sha256

    rows = [(i, np.floor(np.array(v, dtype=np.float64) * 64).astype(np.int64)) for i, v in vectors]
    order = sorted(rows, key=lambda r: (sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    c = [v for _, v in order[:k]]
    for n in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (int(((v - c[j]) ** 2).sum()), j)) for _, v in rows]
        if n < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), o in zip(rows, own, strict=True) if o == j]
                if mine:
                    c[j] = np.array([int(s) // len(mine) for s in np.sum(mine, axis=0)])
    d = [int(((v - c[o]) ** 2).sum()) for (_, v), o in zip(rows, own, strict=True)]
    sums = {j: sum(x for x, o in zip(d, own, strict=True) if o == j) for j in set(own)}
    digest = [sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return sorted(((i, o, x, sums[o], sum(d), digest[o]) for (i, _), o, x in zip(rows, own, d, strict=True)), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_full_scans(spark, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (5, 4))
    vectors = [(i, (middles[i % 5] + rng.normal(0, [0.05, 0.5, 2, 0.02][seed], 4)).tolist()) for i in range(300)]
    if seed == 3:  # ties: few values, many of them equal
        vectors = [(i, (np.round(np.array(v)) / 64).tolist()) for i, v in vectors]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, yinyang.cluster(df, k=9, rounds=5, dims=4, groups=3).collect()), key=repr)
    assert got == brute(vectors, 9, 5)


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(1)
    middles = rng.integers(-500, 500, (12, 6))
    v = middles[rng.integers(0, 12, 3000)] + rng.integers(-30, 30, (3000, 6))
    c = v[:12].copy()
    of = yinyang.grouped(c, 4)
    own = best = lower = None
    moved, work, full = None, 0, 0
    for _ in range(8):
        b = yinyang.Bounds(c, of, moved)
        own, best, lower = b.assign(v, own, None if best is None else np.sqrt(best.astype(float)), lower)
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        others = np.sqrt(d.astype(float))
        others[np.arange(len(v)), own] = np.inf
        for g in range(of.max() + 1):
            assert (lower[:, g] <= others[:, of == g].min(axis=1) + 1e-6).all()
        work, full = work + b.scanned, full + d.size
        new = np.array([v[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else c[j] for j in range(12)])
        moved, c = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)), new
    assert work < full / 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5], "x"), (1, [0.5, -0.5], "x"), (None, [2.0, 2.0], "x"), (2, None, "x"), (3, [], "x"), (4, [1.0], "x"), (5, [nan, 1.0], "x"), (6, [None, 1.0], "x"), (7, [inf, 1.0], "x"), (8, [-2.0, 0.01], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string")
    want = brute([(i, v) for i, v, _ in rows if i in (1, None, 8)], 16, 3)
    assert sorted(map(tuple, yinyang.cluster(df, dims=2).collect()), key=repr) == want
    empty = yinyang.cluster(df.where("vec_id = 5"), dims=2)
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="do not fit 64 bits"):
        yinyang.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), dims=2).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_clusters_equal_sql(spark):
    assert_same(op13_yinyang_clusters(spark, SF).toPandas(), by_sql(SF, yinyang.oracle_sql()))


def test_staged_tables_of_two_threads(spark):
    """One thread's released() leaves another's tables alone."""
    import threading

    made, go, seen = threading.Event(), threading.Event(), []

    def first():
        with released(spark):
            df = stage(spark.range(5), "one")
            made.set()
            go.wait(60)
            seen.append(df.count())

    t = threading.Thread(target=first)
    t.start()
    made.wait(60)
    with released(spark):
        other = stage(spark.range(3), "two")
        assert other.count() == 3
    go.set()
    t.join()
    assert seen == [5]
