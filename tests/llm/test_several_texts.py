"""Ids with several texts in the Jaccard join."""

from __future__ import annotations

import random

from tidewell.llm import jaccard_join as J

from test_texts import plain_components


def test_ids_with_several_texts(spark):
    rng = random.Random(4)
    a, b, c, d, e, f, g = (" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (40, 12, 30, 50, 25, 8, 60))
    rows = [(1, a), (5, a), (5, b), (9, b)]  # 9 is linked through the text of 5 that is no copy
    rows += [(20, c), (20, d), (21, c), (21, d), (22, d), (22, e)]  # two copied texts of one id
    rows += [(30, f), (30, g), (31, f), (32, g), (32, g), (40, "alone here"), (40, ""), (41, None)]
    rows += [(50, g + " more"), (60, "five words that are own"), (60, "five words that are own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    got = J.join_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
