"""Searches by blocks against every pair, with odd vectors and ties."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.operators import blocks, quality, search, vocabulary
from tidewell.sources import term_index


def _hits(df):
    return sorted(((r["query_id"], r["rank"], r["pk"], None if r["score"] is None else repr(round(r["score"], 9))) for r in df.collect()), key=repr)


def test_vectors_by_blocks(spark, monkeypatch):
    for name, size in (("QUERIES", 4), ("ROWS", 90), ("FEW", 50), ("HELD_QUERIES", 3), ("HELD_ROWS", 16)):
        monkeypatch.setattr(blocks, name, size)
    rng = random.Random(3)
    some = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(60)]
    rows = [(i, some[i % 60] if i % 3 else some[7]) for i in range(300)]
    odd = [None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 2.0], [1.0, 2.0], [float("nan")] * 5, [float("inf"), 0.0, 1.0, 0.0, 0.0], [1e200] * 5]
    corpus = spark.createDataFrame(rows + list(enumerate(odd, 1000)) + [(None, some[1])], "pk long, v array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(some[:9] + odd)], "query_id long, q array<double>")
    for metric in ("COSINE", "IP"):
        for limit in (1, 7):
            got = search.dense_top(queries, corpus, "v", limit, metric)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            assert _hits(got) == _hits(search.ranked(search.dense_scores(queries, corpus, "v", metric), limit))
    assert search.dense_top(queries, corpus.where("pk < 0"), "v", 3).count() == 0


def test_rounding_is_that_of_sql(spark):
    values = [0.1234567895, -0.1234567895, 0.1234567885, 1e-10, 5e-10, -5e-10, 123456.0000000005, 3.0, 0.0, 1e300]
    want = [r["r"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9).alias("r")).collect()]
    got = blocks.rounded(blocks.np.array(values))
    assert [round(g / 1e9, 9) for g in got[:-1]] == want[:-1] and got[-1] == 1e300 * 1e9


def test_label_metrics_make_no_pairs(spark, sf):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None), (5, 0)], "pk long, label int")
    hits = spark.createDataFrame([(1, 3, 1), (1, 2, 2), (1, 5, 3), (3, 1, 1), (4, 4, 1)], "query_id long, pk long, rank int")
    asked = labels.where("pk in (1, 3, 4)").withColumnRenamed("pk", "query_id")
    pairs = asked.join(labels, "label").select("query_id", "pk")
    got = quality.label_metrics(hits, asked, labels, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.retrieval_metrics(hits, pairs, 2).collect())) == [(1, 1 / 3, 0.5, 0.5), (3, 0.0, 0.0, 0.0)]
    plan = catalog.retrieval_metrics(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_terms_by_blocks(spark, tmp_path, monkeypatch):
    """As by adding up all postings, of which none is a row of its own; presence counts common words."""
    for name, size in (("QUERIES", 4), ("ROWS", 90), ("FEW", 50)):
        monkeypatch.setattr(blocks, name, size)
    rng = random.Random(4)
    texts = [" ".join([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] + [f"r{rng.randrange(200)}"] * rng.randint(0, 2)) for _ in range(400)] + [None, ""]
    docs = vocabulary.tokenised(spark.createDataFrame(list(enumerate(texts)), "pk long, text string"), "pk", "text")
    index = term_index.build(docs, str(tmp_path / "terms"))
    asked = [(q, t, 0.5 + q % 3) for q in range(11) for t in sorted({*rng.sample("abcdefgh", 3), f"r{q}", "nowhere"})] + [(99, "nowhere", 1.0), (100, "a", 1.0)]
    asked = spark.createDataFrame(asked, "query_id long, term string, w double")
    for allowed in (None, spark.range(0, 400, 3).withColumnRenamed("id", "pk")):
        postings = index.postings if allowed is None else index.postings.join(allowed, "pk", "left_semi")
        got = search.sparse_top(asked, index, 6, allowed=allowed)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(arrays_zip" not in plan and "pks" not in plan
        assert [x[:3] for x in _hits(got)] == [x[:3] for x in _hits(search.ranked(search.sparse_scores(asked, postings), 6))]
        one = asked.withColumn("w", F.lit(1.0))
        got = search.sparse_top(one, replace(index, presence=True), 6, allowed=allowed)
        assert _hits(got) == _hits(search.ranked(search.sparse_scores(one, postings.withColumn("w", F.lit(1.0))), 6))
    assert not term_index.exists(spark, f"{index.at}/blocks")  # inverted only for searches by bounds


def test_counts_beyond_a_byte(spark, tmp_path):
    docs = spark.createDataFrame([(1, [f"w{i}" for i in range(300)]), (2, ["w1"])], "pk long, tokens array<string>")
    index = replace(term_index.build(docs, str(tmp_path / "terms")), presence=True)
    asked = spark.createDataFrame([(1, f"w{i}", 1.0) for i in range(300)], "query_id long, term string, w double")
    assert [(r["pk"], r["score"]) for r in search.sparse_top(asked, index, 2).orderBy("rank").collect()] == [(1, 300.0), (2, 1.0)]


def test_stop_words_are_looked_up(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b w1 W2 a"), (2, None)], "pk long, text string")
    stop = spark.createDataFrame([(f"w{i}",) for i in range(50)] + [("a",), ("a",), (None,)], "word string")
    got = vocabulary.tokenised(docs, "pk", "text", stop)
    assert "INSET" in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(vocabulary, "STOP_WORDS", 3)
    many = vocabulary.tokenised(docs, "pk", "text", stop)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.collect())) == [(1, ["b"]), (2, [])]
    assert vocabulary.tokenised(docs, "pk", "text", stop.where("word = 'x'")).first()["tokens"] == ["a", "b", "w1", "w2", "a"]


def test_queries_by_terms_make_blocks_of_many_terms(spark, tmp_path, monkeypatch):
    """Rows are sent to every block of queries, so short queries share one; of blocks of any size the hits are the same."""
    docs = spark.createDataFrame([(i, [f"w{i * j % 37}" for j in range(1, 9)]) for i in range(300)], "pk long, tokens array<string>")
    index = replace(term_index.build(docs, str(tmp_path / "terms")), presence=True)
    asked = spark.createDataFrame([(q, f"w{q * j % 37}", 1.0) for q in range(60) for j in range(1, 5)], "query_id long, term string, w double").distinct()
    queries = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    terms = asked.count()
    monkeypatch.setattr(blocks, "QUERIES", 4)
    assert blocks.query_blocks(queries) == 15 and blocks.query_blocks(queries, terms="terms") == 1
    want = _hits(search.sparse_top(asked, index, 5))
    monkeypatch.setattr(blocks, "TERMS", 50)
    assert blocks.query_blocks(queries, terms="terms") == -(-terms // 50)
    assert _hits(search.sparse_top(asked, index, 5)) == want
    monkeypatch.setattr(blocks, "TERM_QUERIES", 3)
    assert blocks.query_blocks(queries, terms="terms") == 20 and _hits(search.sparse_top(asked, index, 5)) == want
