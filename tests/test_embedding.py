"""The embedding by hash against a plain count of the same codes."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.functions.vectors import hash_embedding
from tidewell.sources import collection


def test_embedding_counts_in_arrays(spark):
    rows = [(1, ["a", "b", "a", "ß", None]), (2, []), (3, None), (4, ["x"] * 300 + ["y"]), (5, ["a", "b"])]
    made = spark.createDataFrame(rows, "id long, t array<string>").select("id", hash_embedding(F.col("t"), 8).alias("v"))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["v"] for r in made.collect()}
    for i, tokens in rows:
        want = [0.0] * 8
        for t in tokens or []:
            if t is not None:
                code = int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 16
                want[code // 2] += 1.0 if code % 2 else -1.0
        n = math.sqrt(sum(x * x for x in want))
        assert got[i] == [x / n if n else 0.0 for x in want]


def test_embedding_holds_bounded_slices(spark, monkeypatch):
    """Rows are embedded in slices of bounded numbers of tokens, whatever their number in a batch, with the same vectors."""
    rows = pa.array([["a", "b"], None, [], ["c"] * 9, ["d"], ["e", None], ["f"] * 3], pa.list_(pa.string()))
    slices = list(vectors.token_slices(rows, 4))
    assert [x.to_pylist() for x in slices] == [[["a", "b"], None, []], [["c"] * 9], [["d"], ["e", None]], [["f"] * 3]]
    assert pa.concat_arrays(list(vectors.token_slices(rows.slice(3), 2))).to_pylist() == rows.to_pylist()[3:]
    words = [[f"w{i * j % 501}" for j in range(i % 40)] for i in range(300)]
    whole = next(vectors._embedder(16).func(iter([pa.array(words, pa.list_(pa.string()))])))
    sizes, one = [], vectors.pc.list_parent_indices
    monkeypatch.setattr(vectors, "TOKENS", 100)
    monkeypatch.setattr(vectors, "KNOWN", 50)
    monkeypatch.setattr(vectors.pc, "list_parent_indices", lambda x: sizes.append(len(x.flatten())) or one(x))
    assert next(vectors._embedder(16).func(iter([pa.array(words, pa.list_(pa.string()))]))) == whole
    assert max(sizes) <= 100 and sum(sizes) == sum(map(len, words))


def test_ingest_keeps_the_last_record_by_all_columns(spark):
    """Records meet by key before anything is made of them, and the same one of equal keys stays."""
    rows = [(i % 7, f"q{i % 5}", f"a{i % 3}", "qa" if i % 2 else "web", None if i % 4 else "p") for i in range(60)] + [(1, None, None, None, None)] * 2
    records = spark.createDataFrame(rows, "chunk long, question string, answer string, origin string, parent string")
    mapping = collection.Mapping(source="origin", parent="parent", chunk="chunk")
    got, want = collection.last_shaped(records, mapping), collection.latest(collection.shape_records(records, mapping))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    before_shuffle = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "问题" not in before_shuffle
