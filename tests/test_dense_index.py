"""The stored dense index against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell import catalog
from tidewell.sources import dense_index


def recall(got, want):
    found = {(r["query_id"], r["pk"]) for r in got.collect()}
    wanted = {(r["query_id"], r["pk"]) for r in want.collect()}
    return len(found & wanted) / len(wanted)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_the_given_vectors(spark, folder):
    sf = f"/root/testdata/{folder}"
    assert recall(catalog.queries()["dense_graph_search"](spark, sf), catalog.queries()["dense_cosine_search"](spark, sf)) >= 0.9


@pytest.mark.parametrize("clusters", [0, 100])
def test_recall_and_scores_read_over_several_parts(spark, tmp_path, clusters):
    """Every row is indexed; a walk finds what it should and reads a part of the scores."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((12_000, 32))
    v = v * 0.4 + rng.standard_normal((clusters, 32))[rng.integers(0, clusters, len(v))] if clusters else v
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pk long, v array<double>")
    path, read = str(tmp_path / "graphs"), spark.sparkContext.accumulator(0)
    dense_index.build(table, path)
    stored = spark.read.schema(dense_index.STORED).parquet(f"{path}/parts")
    assert dense_index.exists(spark, path) and stored.count() == 3 and stored.agg({"n": "sum"}).first()[0] == len(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = list(range(0, 12_000, 400))
    got = dense_index.top(table.where("pk % 400 = 0").selectExpr("pk as query_id", "v as q"), path, 10, read=read).collect()
    wanted = {(i, int(j)) for i in ids for j in np.argsort(-(unit @ unit[i]), kind="stable")[:10]}
    assert len({(r["query_id"], r["pk"]) for r in got} & wanted) >= 0.9 * len(wanted) and len(got) == len(wanted)
    assert all(abs(r["score"] - unit[r["query_id"]] @ unit[r["pk"]]) < 1e-9 for r in got)
    assert read.value < 0.5 * len(ids) * len(v)
    print("share of scores read", read.value / (len(ids) * len(v)), "recall", len({(r["query_id"], r["pk"]) for r in got} & wanted) / len(wanted))


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 2.0]), (5, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "pk long, v array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "query_id long, q array<double>")
    dense_index.build(table, str(tmp_path / "a"))
    got = dense_index.top(asked, str(tmp_path / "a"), 5).collect()
    assert [(r["query_id"], r["pk"], r["score"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(1, 1, 1.0), (1, 2, 0.0), (1, 4, 0.0), (2, 1, 0.0), (2, 2, 0.0), (2, 4, 0.0)]
    dense_index.build(table.limit(0), str(tmp_path / "b"))
    assert dense_index.top(asked, str(tmp_path / "b"), 5).count() == 0
