"""Metrics by aligned sentences against a plain version."""

from __future__ import annotations

import random
import re

from tidewell.operators import alignment


def plain(response, reference, hits, percent):
    def cut(text):
        parts = ({w for w in re.split(r"[\W_]+", s.lower()) if w} for s in re.split(r"[.!?。！？\n]+", text or ""))
        return [s for s in parts if s]

    def held(claim, text):
        return any(100 * len(claim & s) >= percent * len(claim) for s in cut(text))

    def share(claims):
        return sum(any(held(c, t) for t in hits.values()) for c in claims) / len(claims) if claims else 0.0

    useful = sorted(r for r, t in hits.items() if any(held(c, t) for c in cut(reference)))
    return share(cut(response)), share(cut(reference)), sum((i + 1) / r for i, r in enumerate(useful)) / len(useful) if useful else 0.0


def test_metrics_against_plain(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice(["", "", ".", "!\n"]) for _ in range(n))
    answers = [(i, text(rng.randint(1, 30)), text(rng.randint(1, 30))) for i in range(40)] + [(40, None, ""), (41, "...", None), (42, "a b. a b.", "x 漢字。a"), (43, "a", "b")]
    hits = [(i, r, text(rng.randint(1, 15))) for i in range(40) for r in range(1, rng.randint(1, 6))] + [(40, 1, "a"), (41, 2, None), (42, 1, ""), (42, 3, "B a c d. 漢字 x y"), (42, 4, "none")]
    made = alignment.metrics(spark.createDataFrame(answers, "query_id long, response string, reference string"), spark.createDataFrame(hits, "query_id long, rank int, text string"), 70)
    got = {r["query_id"]: (r["faithfulness"], r["context_recall"], r["context_precision"]) for r in made.collect()}
    assert len(got) == len(answers) and any(0 < x < 1 for v in got.values() for x in v)
    for i, response, reference in answers:
        want = plain(response, reference, {r: t for q, r, t in hits if q == i}, 70)
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[i], want, strict=True)), (i, got[i], want)


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, response string, reference string")
    assert alignment.metrics(none, spark.createDataFrame([], "query_id long, rank int, text string")).count() == 0
