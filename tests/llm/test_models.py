"""op1, op2 and op8: parts against brute force, models by held-out accuracy."""

import html
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetward.llm import html_text, pairwise_quality, queries, toxicity

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def maximal_segments(s):
    """By definition: best segments, then the same to either side."""
    def best(a, b):
        top = (0.0, None)
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > top[0] + 1e-12:
                    top = (total, (i, j + 1))
        return top
    def split(a, b):
        total, at = best(a, b) if a < b else (0, None)
        if at is None:
            return []
        return split(a, at[0]) + [(at[0], at[1], total)] + split(at[1], b)
    return split(0, len(s))


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    rng = np.random.default_rng(seed)
    s = rng.normal(-0.3, 1, int(rng.integers(1, 40)))
    got = toxicity.segments(s)
    want = maximal_segments(s)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert toxicity.segments(-np.abs(s)) == []


def test_lambda():
    s = np.array([1.0] * 10 + [-1.0] * 90)
    lam = toxicity.fit_lambda(s)
    assert abs(np.exp(lam * s).mean() - 1) < 1e-6 and abs(lam - np.log(9)) < 1e-6


def area(score, y):
    a, b = score[y == 1], score[y == 0]
    return float(np.mean(a[:, None] > b[None]) + 0.5 * np.mean(a[:, None] == b[None]))


@needs_tables
@pytest.mark.parametrize("name,label,least", [("op1_quality_bradley_terry", "quality", 0.97), ("op2_toxicity_segments", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = df.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert rows["score"].between(0, 1).all()
    assert area(rows["score"].to_numpy(), rows[label].to_numpy()) >= least
    assert (rows["predicted"] == rows[label]).mean() >= 0.9
    again = queries.QUERIES[name](spark, SF).toPandas().sort_values("doc_id")["score"].to_numpy()
    assert np.allclose(again, df.toPandas().sort_values("doc_id")["score"].to_numpy())


@pytest.mark.parametrize("score", [lambda d, x: pairwise_quality.score(d, x), lambda d, x: toxicity.score(d, x, with_passages=True)])
def test_odd_rows(spark, score):
    rng = random.Random(0)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    texts = [clean() for _ in range(60)] + [clean() + " vile scum vile scum ### *** " + clean()[:30] for _ in range(60)]
    docs = [(k, t, 0.0) for k, t in enumerate(texts)] + [(1000, None, 0.0), (1001, "", 0.0), (1002, "  ", 0.0), (None, "vile scum", 0.0), (0, texts[0], 1.0), (1003, "word " * 60000, 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k < 60), int(k >= 60)) for k in range(120)] + [(None, 1, 1), (5, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = score(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"]: r["held_out"] for r in got}
    import zlib
    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())
    own = np.array([(r["score"], r["doc_id"] < 60) for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and r["held_out"]])
    assert len({r["score"] > 0.5 for r in got if r["doc_id"] is not None and r["doc_id"] < 120}) == 2 and abs(area(own[:, 0], own[:, 1]) - 0.5) > 0.45
    assert score(df.limit(0), labels).count() == 0
    assert {r["score"] for r in score(df, labels.limit(0)).collect()} == {0.5}


def test_toxic_passages(spark):
    rng = random.Random(1)
    clean = lambda n: [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"]) for _ in range(n)]
    bad = ["vile", "scum", "filth"]
    docs = [(k, " ".join(clean(30))) for k in range(100)] + [(100 + k, " ".join(clean(20) + bad + clean(20))) for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") >= 100).cast("int").alias("toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(df, labels, with_passages=True).collect()}
    assert all(got[k]["predicted"] == int(k >= 100) for k in got)
    assert all([(p["first"], p["end"]) for p in got[k]["passages"]] == [(20, 23)] for k in range(100, 200))


def test_toxicity_score_by_brute_force(spark):
    """Log-odds, lambda, K and evidence from plain counts of words, with no tables and no linear scan."""
    import zlib
    from math import exp, log, log1p

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    foul = ["vilest", "vile", "scummy", "scum"]
    texts = [" ".join(rng.choice(vocab + foul * (1 + 4 * (k >= 60))) for _ in range(rng.randint(5, 40))) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(120)], "doc_id long, toxic int")
    later = {r["doc_id"]: r["m"] == 0 for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(4)).alias("m")).collect()}
    learnt = [k for k in range(120) if zlib.crc32(str(k).encode()) % 5]
    levels = [lambda w: w, lambda w: w[:6], lambda w: w[:4]]
    count = [{}, {}, {}]
    for k in learnt:
        if not later[k]:
            for w in texts[k].split():
                for own, level in zip(count, levels, strict=True):
                    n = own.setdefault(level(w), [0, 0])
                    n[0] += 1
                    n[1] += k >= 60
    rate = sum(n[1] for n in count[0].values()) / sum(n[0] for n in count[0].values())

    def scores(text):
        out, before = [], None
        for w in text.split():
            if w == before:
                out.append(-toxicity.DRIFT)
                continue
            p, before = rate, w
            for own, level in zip(count[::-1], levels[::-1], strict=True):
                n = own.get(level(w), [0, 0])
                p = (n[1] + toxicity.PRIOR * p) / (n[0] + toxicity.PRIOR)
            p = min(max(p, 1e-6), 1 - 1e-6)
            out.append(log(p / (1 - p)) - log(rate / (1 - rate)) - toxicity.DRIFT)
        return out

    sample = [k for k in learnt if later[k]]
    model = toxicity.fit(df, labels)
    clean = [x for k in sample if k < 60 for x in scores(texts[k])]
    assert abs(np.mean(np.exp(model["lam"] * np.round(np.array(clean) * 8) / 8)) - 1) < 1e-3
    best = lambda s: max((x[2] for x in maximal_segments(s)), default=0.0)
    tail = [model["lam"] * best(scores(texts[k])) - log(len(texts[k].split())) for k in sample if k < 60 and len(texts[k].split()) > 20]
    assert abs(model["log_k"] - (np.mean(tail) - 0.5772)) < 1e-6
    curve, got = model["curve"], {r["doc_id"]: r for r in toxicity.score(df, labels, with_passages=True).collect()}
    for k, text in enumerate(texts):
        s = scores(text)
        found = maximal_segments(s)
        base = model["log_k"] + log(len(s))
        normal = [model["lam"] * x[2] - base for x in found]
        passages = [(a, b) for (a, b, _), v in zip(found, normal, strict=True) if v >= -log(toxicity.EXPECTED)]
        x = [max(normal, default=-base), log1p(sum(max(0.0, model["lam"] * v - 2.0) for *_, v in found)), log1p(sum(v for v in normal if v >= -log(toxicity.EXPECTED))), log1p(len(s))]
        z = sum((v - m) / d * c for v, m, d, c in zip(x, curve["mean"], curve["sd"], curve["c"], strict=False)) + curve["c"][-1]
        assert abs(got[k]["score"] - 1 / (1 + exp(-min(max(z, -30), 30)))) < 1e-5
        assert [(p["first"], p["end"]) for p in got[k]["passages"]] == passages
    assert list(next(iter(got.values())).asDict())[:4] == ["doc_id", "held_out", "score", "predicted"]


def test_strengths_minimise_the_pairs_loss():
    """No step in any direction lowers the logistic loss of the pairs' feature differences by much."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=300) > 0).astype(float)
    model = pairwise_quality.fit_strengths(x, y, pairs=4000)
    z = pairwise_quality.expand(x, model["mean"], model["sd"])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.Generator(np.random.PCG64(11))
    diff = z[draw.choice(good, 4000)] - z[draw.choice(bad, 4000)]
    scale = np.sqrt((diff**2).mean(axis=0)) + 1e-6
    loss = lambda w: np.mean(np.log1p(np.exp(-(diff @ w)))) + pairwise_quality.PENALTY / 2 * np.sum((w * scale) ** 2)
    here = loss(model["w"])
    for i in range(z.shape[1]):
        for step in (0.01, -0.01, 0.1, -0.1, 1.0, -1.0):
            w = model["w"].copy()
            w[i] += step
            assert loss(w) > here - 1e-3


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_kept_is_a_quantile_of_all_scores(spark, share):
    """Scores by hand from the fitted curve; kept are those not below the quantile, ties included."""
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["abc", "De.", "#", "fghij"]) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["same words"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = pairwise_quality.fit(df, labels)["model"]
    mid, wide, a, c = model["curve"]
    want = []
    for t in texts:
        z = pairwise_quality.expand(np.array(pairwise_quality.features(t)), model["mean"], model["sd"])
        want.append(1 / (1 + np.exp(-np.clip(a * (float(z @ model["w"]) - mid) / wide + c, -30, 30))))
    got = {r["doc_id"]: r for r in pairwise_quality.score(df, labels, share).collect()}
    assert np.allclose([got[k]["score"] for k in range(80)], want, atol=1e-9)
    cut = sorted(got[k]["score"] for k in range(80))[max(0, int(np.ceil(share * 80)) - 1)]
    assert all(got[k]["kept"] == (got[k]["score"] >= cut) and got[k]["predicted"] == int(got[k]["score"] >= 0.3) for k in got)


def test_ids_beside_null(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b c"), (None, "d e f")], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(9)], "doc_id long, quality int, toxic int")
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    for out in (pairwise_quality.score(df, labels), toxicity.score(df, labels), html_text.main_text(pages)):
        assert {r[0] for r in out.collect()} == {big, None}


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<p "' + "<a b" * 250_000, '<p "' + "<a b>" * 200_000, "<div>" * 8000 + "</x>" * 240_000, "<" * 1_000_000, "<a \"'>" * 160_000, "&#" + "9" * 1_000_000 + ";"])
def test_broken_pages_of_a_megabyte(model, page):
    import time

    began = time.process_time()
    html_text.extract(page, model)
    assert time.process_time() - began < 5


def test_tags_with_and_without_closed_quotes():
    tags = lambda x: [(t, p.strip()) for _, p, _ in [q for q in html_text.Page(x).pieces if q] for t in [0]]
    assert [p for _, p in tags("<p class=\"a>b\">one<p title='x>y'>two")] == ["one", "two"]
    assert [p for _, p in tags("<p class=\"open>one</p><b>two")] == ["one", "two"]
    assert html_text._unescaped("&#0000065;&#x41;&amp;&#99999999999;&lt") == "AA&\ufffd<"


@pytest.fixture(scope="module")
def model():
    return html_text.fit(html_text.training_pages())


def test_marginals_equal_enumeration(model):
    import itertools

    page = html_text.Page("<body><nav><a href=x>one</a></nav><div class=content><p>Some words here.</p><div class=ad>buy</div></div></body>")
    facts, n = page.facts(), len(page.parent)
    total = np.zeros(n)
    norm = 0.0
    for y in itertools.product(range(3), repeat=n):
        p = model["root"][y[0]]
        for v in range(n):
            p *= np.exp(sum(model["unary"].get(f, (0, 0, 0))[y[v]] for f in facts[v]))
            if v:
                p *= model["edge"][y[page.parent[v]]][y[v]]
        norm += p
        total += p * (np.array(y) == html_text.CONTENT)
    assert np.allclose(total / norm, html_text.marginals(page, model), atol=1e-9)


def test_held_out_rule_pages(model):
    right = wrong = missed = 0
    for source in html_text.training_pages(150, 77):
        page = html_text.Page(source)
        y, p = html_text.states(page), html_text.marginals(page, model)
        for piece in page.pieces:
            if piece and piece[1].strip():
                kept, real, n = p[piece[0]] >= 0.5, y[piece[0]] == html_text.CONTENT, len(piece[1])
                right, wrong, missed = right + n * (kept and real), wrong + n * (kept and not real), missed + n * (real and not kept)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.95


@needs_tables
def test_pages_of_the_table(spark):
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op8_html_tree_model"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", body)))
        assert got[r["page_id"]] == " ".join(want.split())


def test_odd_pages(spark, model):
    pages = [
        (1, "u", None), (2, "u", ""), (3, "u", "<"), (4, None, "plain & simple"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "u", "<article><p>A&amp;B &lt;x&gt; &#233;&eacute; <b>bo</b>ld.<p>Two\n  lines</article>"),
        (7, "u", "<script>var a = '<p>no</p>'"), (8, "u", "<!-- <p>no</p> --><article><p>Yes, this is text.</p><style>p{}</style></article><!-- open"), (None, "u", "<article><p>Null id here.</p></article>"), (6, "u", "<article><p>Again this text.</p></article>"),
    ]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")
    got = html_text.main_text(df).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {(r["page_id"], r["text"]) for r in got}
    assert (6, "A&B <x> éé bold. Two lines") in text and (8, "Yes, this is text.") in text and (1, "") in text and (7, "") in text
    assert html_text.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>x</title><article>{a}</article>", "{t}"),
        ("<head><meta charset=utf-8><link href=x><style>p {{}}</style><body>{a}</body>", "{t}"),
        ("<head><title>t</title>Text ends the head. It is the body's own.", "Text ends the head. It is the body's own."),
        ("<head><noscript><p>No script here.</p></noscript><title>t</title></head><main>{a}</main>", "{t}"),
        ("<!-->{a}<!-- gone -->", "{t}"), ("<!--->{a}<!-- gone --!>", "{t}"), ("<!-- <p>gone</p> -->{a}", "{t}"),
        ("Just a text without tags. It has two sentences.", "Just a text without tags. It has two sentences."),
        ("word", "word"), ("a &amp;  b\nc", "a & b c"),
        ("<body>Plain text. With <b>bold</b>\n words.</body>", "Plain text. With bold words."),
        ("First line of a page.<br>Second line of it.", "First line of a page. Second line of it."),
        ("<body><a href=/>Home</a> | <a href=/a>About us</a> | <a href=/c>Contact</a><article>{a}</article></body>", "{t}"),
    ],
)
def test_pages_with_omitted_tags_and_loose_text(page, want):
    """Valid pages without head's end or body's start, without any tag, with empty comments."""
    text = "A first sentence stands here, long enough to be prose. Another one follows it at once."
    model = html_text.fit(html_text.training_pages())
    assert html_text.extract(page.format(a=f"<p>{text}</p>" * 3), model) == want.format(t=" ".join([text] * 3))


def test_text_on_pages_of_another_generator():
    """Pages that the fit has not written: other words, nesting and omitted tags; recall and precision of words."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("bcdfghkpqvwxyz"), int(rng.integers(3, 9))))
    said = lambda n: " ".join(" ".join(word() for _ in range(int(rng.integers(5, 14)))).capitalize() + "." for _ in range(n))
    model = html_text.fit(html_text.training_pages())
    hit = found = wanted = 0
    for k in range(60):
        body, junk = [said(int(rng.integers(2, 5))) for _ in range(int(rng.integers(2, 7)))], [said(1) for _ in range(3)]
        menu = "".join(f"<li><a href=#>{word()}</a>" for _ in range(6))
        article = "".join(f"<p>{x}" for x in body)
        head = ["<!doctype html><title>t</title>", "<html><head><title>t</title></head><body>", "<head><meta charset=utf-8><title>t</title><body class=site>"][k % 3]
        wrap = [f"<main id=primary><div class=row><article>{article}</article></div></main>", f"<div class=container><div class=story>{article}</div></div>", f"<section><h2>{said(1)}</h2>{article}</section>"][k // 3 % 3]
        page = f"{head}<nav><ul>{menu}</ul></nav>{wrap}<aside><p>{junk[0]}</aside><div class=comments><p>{junk[1]}</div><footer>{junk[2]}</footer>"
        got, want = html_text.extract(page, model).split(), " ".join(body).split()
        hit += len(set(got) & set(want))
        found, wanted = found + len(set(got)), wanted + len(set(want))
    assert hit / wanted > 0.97 and hit / found > 0.95
