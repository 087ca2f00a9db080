"""Classifiers, neighbours, pages and URLs on awkward tables."""

from __future__ import annotations

import collections
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.llm import ann, html_main, quality, toxicity, url_filter
from tidewell.llm.common import join_by_size
from tidewell.llm.ngram_linear import Grams, NgramSpec, hinge_dual, platt


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(240):
        text = [word() for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), "zzvile")
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


@pytest.mark.parametrize(("train", "score"), [(toxicity.train_toxicity, toxicity.score_toxicity), (quality.train_quality, quality.score_quality)])
def test_classifiers(spark, labelled, awkward, nothing, train, score):
    labels = labelled.select("doc_id", "y").unionByName(spark.createDataFrame([(3, None), (None, 1), (4, 7), (8, 1)], "doc_id long, y int"))
    model = train(labelled, labels, F.col("doc_id") % 3 != 0, label="y")
    got = score(labelled, model).where("doc_id % 3 = 0").collect()
    assert np.mean([(r["_tw_score"] >= 0.3) == r["y"] for r in got]) > 0.9
    assert score(awkward, model).columns == [*awkward.columns, "_tw_score"] and score(awkward, model, into="score").columns == awkward.columns
    odd = score(awkward, model, into="tox")
    assert odd.count() == awkward.count() and odd.where("tox between 0 and 1").count() == awkward.count()
    assert score(nothing, model).count() == 0
    for none in (train(nothing, labels, label="y"), train(labelled, labels.limit(0), label="y")):
        assert score(awkward, none, into="tox").where("tox = 0").count() == awkward.count()
    assert score(awkward, train(labelled, labels.where("y = 1"), label="y"), into="tox").where("tox = 1").count() == awkward.count()


def test_distinct_grams():
    g = Grams(NgramSpec(orders=(2, 3), bits=16))
    ids = g.hashed("abab abab")
    assert sorted(g.distinct(ids)) == sorted(set(ids.tolist())) and len(ids) == (11 - 1) + (11 - 2)
    assert len(g.hashed("")) == 1


def test_dual_meets_the_hinge_optimum():
    """The dual's point has the primal's smallest value, by checking it against small moves."""
    rng = np.random.default_rng(2)
    x = (rng.random((40, 6)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.standard_normal(40) > 0.7).astype(int)
    ratios = np.array([1.0, 0.8, -0.5, 0.3, 0.2, -0.9])
    cols = [np.flatnonzero(r) for r in x]
    indptr = np.concatenate([[0], np.cumsum([len(c) for c in cols])])
    w, bias, slope, _ = hinge_dual(c=1.0, epochs=2000)(indptr, np.concatenate(cols), ratios, y)
    cost = np.where(y == 1, 20 / max(1, (y == 1).sum()), 20 / max(1, (y == 0).sum()))
    sign = np.where(y == 1, 1, -1)
    primal = lambda v, b: 0.5 * (v @ v + b * b) + cost @ np.maximum(0, 1 - sign * (x * ratios @ v + b))
    best = primal(w, bias)
    assert all(primal(w + 0.01 * d, bias + 0.01 * e) >= best - 1e-3 for d, e in ((rng.standard_normal(6), rng.standard_normal()) for _ in range(300)))
    assert slope > 0


def test_platt():
    a, b = platt(np.array([-2.0, -1.0, 1.0, 2.0] * 50), np.array([0, 0, 1, 1] * 50))
    assert a > 0 and abs(b) < 0.1


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12)) * rng.random((400, 1))
    x[100:160] = x[100]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] * 12), (904, [1.0]), (905, []), (None, x[0].tolist()), (906, [float("inf")] * 12), rows[5]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "list": F.lit("x")})
    spec = ann.AnnSpec(k=7, reach=1.0, slack=8.0, block=64)
    got = collections.defaultdict(list)
    for r in ann.search(vectors, F.col("id") % 20 == 0, spec=spec).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:7]
        assert [(r, v) for r, v, _ in found] == list(enumerate(want, 1))
        assert np.allclose([s_ for _, _, s_ in found], s[want], atol=1e-12)
    assert ann.search(vectors.limit(0), F.col("id") % 20 == 0).count() == 0
    few = ann.search(vectors.where("vec_id < 3"), F.col("id") % 20 == 0, spec=spec)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2]


def test_scanned_block_against_plain():
    """One block without a floor gives exactly the best of all; with floors, no more than those that reach them."""
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((300, 20)), rng.standard_normal((9, 20))
    spec = ann.AnnSpec(k=5, slack=9.0)
    index = ann.Index(np.linalg.qr(rng.standard_normal((21, 21)))[0], np.zeros((1, 21)), float((x * x).sum(1).max()))
    cuts = ann.blocks_of(20, spec)
    split = lambda y: [y[:, a:b].astype(np.float32) for a, b in zip(cuts, cuts[1:], strict=False)]
    ids, asked = np.arange(300), np.arange(1000, 1009)
    for floor in (np.full(9, -np.inf), np.sort(q @ x.T, 1)[:, -3] - 1e-9):
        got, read = ann.scan(x, split(index.place(x)), ids, q, split(index.ask(q)), asked, floor, index.norm, spec)
        for i in range(9):
            s = q[i] @ x.T
            want = [j for j in np.lexsort((ids, -s)) if s[j] >= floor[i]][:5]
            assert got[got["query_id"] == 1000 + i]["vec_id"].tolist() == want
        assert read <= 9 * 300 * (21 + 20)


@pytest.mark.parametrize(("clusters", "share"), [(0, 0.8), (150, 0.25)])
def test_recall_at_the_defaults(spark, clusters, share):
    """20,000 vectors, with and without clusters: recall of nine tenths and more, and most components never read."""
    rng = np.random.default_rng(clusters)
    n, d = 20_000, 32
    x = rng.standard_normal((n, d))
    if clusters:
        x = 0.3 * x + rng.standard_normal((clusters, d))[rng.integers(0, clusters, n)]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float64)
    x[:40] = x[19_000]  # ties across all ranks
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    read = spark.sparkContext.accumulator(0)
    got = ann.search(vectors, F.col("id") % 200 == 0, read=read).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(n), -s))[:20]
        hits += len(set(want) & set(found["vec_id"]))
        if q == 19_000:
            assert found.sort_values("rank")["vec_id"].tolist() == list(range(20))
    assert got.groupby("query_id").size().eq(20).all() and hits >= 0.9 * 100 * 20
    assert read.value <= share * 100 * n * d


def test_minimum_cut_against_all_labellings():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 7)
        scores = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6), rng.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda lab: sum(s for s, c in zip(scores, lab, strict=True) if s > 0 and not c) + sum(-s for s, c in zip(scores, lab, strict=True) if s < 0 and c) + sum((there if lab[a] else back) for a, b, there, back in edges if lab[a] != lab[b])
        every = list(itertools.product([False, True], repeat=n))
        best = [x for x in every if cost(x) == min(map(cost, every))]
        assert tuple(html_main.minimum_cut(scores, edges)) == max(best, key=sum)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="has-sidebar">
<div class="cookie-notice"><p>We use cookies. Please accept them all now, it is good for you.</p></div>
<div id="menu"><a href=x>Home</a> <a>News</a></div><header><h1>Site</h1></header>
<div class="content"><h1>The title</h1><p>A long paragraph of text here, with a &amp; ref &eacute; and <a href=q>a link</a>.<p>Short.
<div class=ad>Buy this now. It is cheap and nice to have, they say.</div><script>if (a < b) "<p>no</p>"</script>
<p>More   text that\n is real content.</p><form><label>Mail</label><textarea>no</textarea></form></div><!-- <p>no</p> -->
<div id=comments><p>I like this article very much indeed, thanks.</p></div><footer>&copy; 2020</footer>"""


def test_pages(spark):
    long = "<div>" * 3000 + "<p>Text of some length that is good to read, it says. " * 3000
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p"), (5, "plain words only, no tags at all here."), (6, long), (6, long), (7, "<a>x</a>" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"n": F.lit(0), "text": F.lit("own"), "words": F.lit("w")})
    out = html_main.extract(pages)
    assert out.columns == [*pages.columns, "_tw_text"] and html_main.extract(pages, into="text").columns == pages.columns
    got = [(r["page_id"], r["_tw_text"]) for r in out.collect()]
    text = dict(got)
    assert text[1] == "The title\nA long paragraph of text here, with a & ref é and a link.\nShort.\nMore text that is real content."
    assert text[2] == text[3] == text[4] == text[7] == "" and len(got) == len(rows) and text[6].count("\n") == 2999
    assert html_main.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def plain_rule(url):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in RULES for own, _, rest in [r.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + rest)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    rng = random.Random(6)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['www.', 'm.', ''])}{rng.choice(['foo', 'Bar', 'baz'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(1, 9999)}{rng.choice(['', '?q=1', '#x', '/'])}" for _ in range(300)]
    urls += [None, "", "no scheme/at/all", "http://", "x://COM/en/", "http://com/en/1", "http://xcom/en/1", "a?://b.com#/en/", "http://é.com/en/7", "http://a.com/en/\n", "http://a.example.com/" + "z" * 20_000, urls[0], urls[0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"score": F.lit(1.0), "rule": F.lit("r"), "host": F.lit("h")})
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        r = got[i]
        assert (r["_tw_host"], r["_tw_path"], r["_tw_rule"]) == (host, path, rule), u
        assert r["_tw_verdict"] == (verdict or ("allow" if r["_tw_score"] >= 0 else "block"))
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    assert url_filter.filter_urls(pages, []).where("_tw_verdict = 'allow'").count() == len(urls)


def test_rows_of_a_long_url_are_short(spark):
    url = "http://a.example/" + "zé漢x" * 10_000
    rows = url_filter._windows(spark.createDataFrame([(b"k" * 16, url)], "_tw_key binary, _tw_url string"), 4)
    got = rows.select(F.sum(F.length("gram")).alias("n"), F.count(F.lit(1)).alias("rows"), F.max(F.length("_tw_key"))).first()
    assert tuple(got) == (5 * (len(url) + 1), len(url) + 1, 16) and rows.columns == ["_tw_key", "gram"]
    padded = "\u0002" * 4 + url + "\u0003"
    assert {r["gram"] for r in rows.distinct().collect()} == {padded[i : i + 5] for i in range(len(url) + 1)}


def test_hot_and_cold_keys_are_joined_alike(spark):
    left = spark.createDataFrame([("a", i) for i in range(5000)] + [(f"k{i}", i) for i in range(30)], "k string, v int")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).unionByName(spark.createDataFrame([("none", 0, 0)], "k string, n long, top int"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    for small in (True, False):
        assert sorted(map(tuple, join_by_size(left, right, "k", "n", 5030, small).collect())) == want


def test_url_model_against_plain(spark):
    labelled = [("abab", True), ("abc", True), ("bbb", False), ("cab", False), ("ab", False)]
    order = 2
    ask = ["abab", "bc", "zz", ""]
    n = {True: collections.Counter(), False: collections.Counter()}
    for u, ok in labelled:
        p = "\u0002" * order + u + "\u0003"
        for i in range(order, len(p)):
            for k in range(order + 1):
                n[ok][p[i - k : i + 1]] += 1

    def chance(c, gram):
        p = 1 / 256
        for k in range(len(gram)):
            ctx = gram[len(gram) - 1 - k : -1]
            after = {g: x for g, x in c.items() if len(g) == k + 1 and g[:-1] == ctx}
            if after:
                p = (after.get(ctx + gram[-1], 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p

    want = {}
    for u in ask:
        p = "\u0002" * order + u + "\u0003"
        for i in range(order, len(p)):
            g = p[i - order : i + 1]
            want[g] = math.log(chance(n[True], g)) - math.log(chance(n[False], g))
    seen = spark.createDataFrame(labelled, "_tw_url string, accepted boolean")
    windows = url_filter._windows(spark.createDataFrame([(u, 1) for u in ask], "_tw_url string, own int"), order)
    assert windows.columns == ["own", "gram"]
    grams = windows.select("gram").distinct()
    got = {r["gram"]: r["ratio"] for r in url_filter.ratio_table(seen, grams, order).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[g], want[g], abs_tol=1e-9) for g in want)
