"""The n-gram classifiers against plain versions: hashes, counts, ratios, the solver's optimum, the scores."""

from __future__ import annotations

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import toxicity
from tidewell.llm.ngram_linear import Grams, NgramSpec, log_count_ratios, logistic, scaled_features

SPEC = NgramSpec(orders=(2, 3), bits=16, features=40, least_docs=2, sample=1000)
TEXTS = [("a bad thing", 1), ("bad bad BAD", 1), ("so bad, bad", 1), ("a good thing", 0), ("good day", 0), ("the day is fine", 0), ("", 0), ("ü fine 漢字", 0), ("bad", 1), ("fine thing", 0)]


def plain_grams(text: str) -> set[int]:
    text, out = f" {text.lower()} ", set()
    for n in SPEC.orders:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x01000193 + ord(c) * 0x9E3779B1) % (1 << 32)
            mixed = (h ^ h >> 15) * (0x85EBCA6B + 2 * n) % (1 << 32)
            out.add((mixed ^ mixed >> 13) >> (32 - SPEC.bits))
    return out


def plain_model() -> tuple[dict[int, float], np.ndarray]:
    """(kept n-gram -> ratio, documents of each class)"""
    n = (collections.Counter(), collections.Counter())
    for text, y in TEXTS:
        n[y].update(plain_grams(text))
    docs = [sum(y == k for _, y in TEXTS) for k in (0, 1)]
    found = {}
    for g in n[0] | n[1]:
        a, b = n[0][g], n[1][g]
        ratio = math.log(((b + 1) / (docs[1] + 2)) / ((a + 1) / (docs[0] + 2)))
        if a + b >= SPEC.least_docs and ratio:
            found[g] = (abs(ratio) / math.sqrt(1 / (b + 1) + 1 / (a + 1)), ratio)
    kept = sorted(found, key=lambda g: (-round(found[g][0], 12), g))[: SPEC.features]
    return {g: found[g][1] for g in kept}, np.array(docs, dtype=float)


def test_hashes_and_ratios(spark):
    grams = Grams(SPEC)
    for text, _ in TEXTS:
        assert set(grams.distinct(grams.hashed(text)).tolist()) == plain_grams(text)
    train = spark.createDataFrame([(i, y, t) for i, (t, y) in enumerate(TEXTS)], "_id long, y int, text string").repartition(3)
    n0, n1, docs = log_count_ratios(train, SPEC)
    kept, ratios = scaled_features(n0, n1, docs, SPEC)
    want, sizes = plain_model()
    assert docs.tolist() == sizes.tolist() and len(kept) == len(want) == SPEC.features
    strongest = {g for g in want if abs(want[g]) > 1.0}
    assert strongest <= set(kept.tolist()) and all(math.isclose(r, want[g]) for g, r in zip(kept.tolist(), ratios, strict=True) if g in want)


def test_logistic_meets_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.random((80, 7)) < 0.4
    y = (x[:, 0] + x[:, 1] + 0.4 * rng.standard_normal(80) > 0.8).astype(int)
    ratios = np.array([1.2, 0.8, -0.6, 0.3, 0.5, -0.9, 0.1])
    cols = [np.flatnonzero(r) for r in x]
    indptr = np.concatenate([[0], np.cumsum([len(c) for c in cols])])
    w, bias, slope, shift = logistic(per_row=0.01, rounds=3000)(indptr, np.concatenate(cols), ratios, y)
    z = lambda v, b: (x * ratios) @ v + b
    value = lambda v, b: np.logaddexp(0, np.where(y == 1, -z(v, b), z(v, b))).sum() + 0.01 * 80 / 2 * v @ v
    best = value(w, bias)
    assert (slope, shift) == (1.0, 0.0)
    assert all(value(w + 0.02 * rng.standard_normal(7), bias + 0.02 * rng.standard_normal()) >= best - 1e-4 for _ in range(300))


def test_scores_are_those_of_the_table(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(TEXTS)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels, spec=SPEC)
    for r in toxicity.score_toxicity(docs, model).collect():
        z = model.bias + sum(float(model.table[g]) for g in plain_grams(r["text"]))
        assert math.isclose(r["_tw_score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6)
    toxic = toxicity.score_toxicity(docs, model).join(labels, "doc_id").groupBy("toxic").agg(F.avg("_tw_score").alias("s")).collect()
    mean = {r["toxic"]: r["s"] for r in toxic}
    assert mean[1] > mean[0] + 0.3
