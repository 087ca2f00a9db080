"""Training over all documents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import hmm


def test_training_rounds_see_all_documents(spark, monkeypatch):
    n, seen, one_round = 5000, [], hmm.baum_welch_round

    def counted(rows, *rest):
        seen.append(rows.count())
        return one_round(rows, *rest)

    monkeypatch.setattr(hmm, "baum_welch_round", counted)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    assert hmm.score_documents(docs, F.lit(True), spec=hmm.HmmSpec(states=2, emitted=64, classes=16, known=128, sample_rounds=2, rounds=1)).count() == n
    assert seen == [n] * 3


def test_tree_of_sums(spark):
    """Sums over many tasks by a tree of fan two are those of one group, and no group has more than two rows of a block."""
    texts = spark.range(0, 300, 1, 23).select(F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k) % 91) for k in range(1, 9)]).alias("_text"), F.lit(True).alias("_learn"))
    results = []
    for spec, tasks in ((hmm.HmmSpec(states=2, emitted=64, classes=16, known=128, block=16, fan=2), 23), (hmm.HmmSpec(states=2, emitted=64, classes=16, known=128), 1)):
        vocabulary = hmm.Vocabulary(hmm.count_tokens(texts, spec), spec)
        rows = hmm.encode(texts, vocabulary).select("symbols")
        results.append(hmm.baum_welch_round(rows, hmm.Hmm.begin(vocabulary.frequency, 2), vocabulary.frequency, spec, tasks))
    (a, x), (b, y) = results
    assert np.allclose(a.emit, b.emit, rtol=1e-5) and np.allclose(a.move, b.move) and np.allclose(a.start, b.start) and np.isclose(x, y)


def test_symbols_grow_with_the_types(spark):
    spec = hmm.HmmSpec(emitted=8, classes=4, known=1024, growth=5)
    of = lambda n: hmm.Vocabulary(hmm.count_tokens(spark.range(n * 2).select(F.concat(F.lit("w"), F.col("id") % n).alias("_text"), F.lit(True).alias("_learn")), spec), spec)
    assert [of(n).emitted for n in (2, 30, 99, 398)] == [3, 27, 50, 99]


def test_new_words_of_held_out_rows(spark):
    """A word that only rows outside training have, in all of them and many times over, is scored like any unknown one."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat_ws(" ", F.lit("new new new"), F.concat(F.lit("w"), F.col("id") % 5))).otherwise(F.concat(F.lit("w"), F.col("id") % 7)).alias("text"))
    spec = hmm.HmmSpec(states=2, emitted=64, classes=16, known=128, sample_rounds=1, rounds=1)
    got = hmm.score_documents(docs, F.col("doc_id") % 2 == 1, spec=spec).where("doc_id % 2 = 0").select("n_tokens", "n_known", "base_score", "doc_id").collect()
    n, v = 3000, 8
    c = {f"w{i}": sum(1 for x in range(1, 3000, 2) if x % 7 == i) for i in range(7)}
    for r in got:
        want = 3 * math.log10(0.1 / (n + 0.1 * (v + 1))) + math.log10((c[f"w{r['doc_id'] % 5}"] + 0.1) / (n + 0.1 * (v + 1))) + math.log10((1500 + 0.1) / (n + 0.1 * (v + 1)))
        assert (r["n_tokens"], r["n_known"]) == (5, 2) and math.isclose(r["base_score"], want, rel_tol=1e-9)
    small = hmm.Vocabulary(hmm.count_tokens(docs.select(F.col("text").alias("_text"), (F.col("doc_id") % 2 == 1).alias("_learn")), spec), spec)
    assert b"new" in small.words


def test_counts_and_classes(spark, awkward):
    """Counts by word are those of a plain count, and classes the same in Spark and in Python."""
    spec = hmm.HmmSpec(classes=16)
    rows = awkward.select(F.coalesce("text", F.lit("")).alias("_text"), (F.coalesce("doc_id", F.lit(0)) % 4 != 0).alias("_learn"))
    want: dict = {}
    for r in rows.collect():
        for w in r["_text"].encode().lower().split() + [b""]:
            want.setdefault(w, [0, 0])[not r["_learn"]] += 1
    got = hmm.count_tokens(rows, spec).collect()
    assert {bytes(r["word"]): [r["c"], r["other"]] for r in got} == want
    assert all(r["k"] == hmm.word_class(bytes(r["word"]), spec) for r in got) and len({r["k"] for r in got}) > 8
