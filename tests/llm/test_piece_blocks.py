"""Units of many texts searched together give what each gives alone."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import pieces


def test_blocks_of_units(monkeypatch):
    v = pieces.Vocabulary.read()
    rng = random.Random(4)
    units = ["".join(rng.choice("abthe niose▁é漢\x00\ud800😀ón") for _ in range(rng.randint(1, 20))) for _ in range(800)]
    units = list(dict.fromkeys([u.replace(" ", "x") if rng.random() < 0.5 else " " + u.replace(" ", "") for u in units] + [" ", "\n", "▁", " ▁", " the", "a" * 64]))
    own = pieces.Units(v)
    assert own.best_of(units) == [own.best_two(u) for u in units]


def test_short_units_are_searched_together(monkeypatch):
    """Also where the bound on what is kept is passed again and again."""
    v = pieces.Vocabulary.read()
    rng = random.Random(5)
    texts = ["", *(" ".join("".join(rng.choice("abthe") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(200)), "b" * 300, "the\nend"]
    alone = pieces.Encoder(v, 4)
    monkeypatch.setattr(alone.units, "learn", lambda names: None)
    want = [alone.encode(t) for t in texts]
    for most in (60_000, 3000):
        monkeypatch.setattr(pieces.Units, "MOST", most)
        together, single = pieces.Encoder(v, 4), []
        monkeypatch.setattr(together.units, "best_two", lambda u, f=together.units.best_two, single=single: single.append(u) or f(u))
        assert list(together.encode_all(texts)) == want
        assert [u for u in single if len(u) <= 64] == []


def test_frequent_units_stay_known(monkeypatch):
    """Units that come in every text are searched once, however often rare ones pass the bound on what is kept."""
    rng = random.Random(6)
    texts = [" ".join(["often", "comes", *("".join(rng.choice("abthe") for _ in range(12)) for _ in range(60))]) for _ in range(400)]
    monkeypatch.setattr(pieces.Units, "MOST", 5000)
    seen, coder, search = [], pieces.Encoder(pieces.Vocabulary.read(), 1), pieces.Units.searched
    monkeypatch.setattr(pieces.Units, "searched", lambda self, units: seen.extend(units) or search(self, units))
    assert len(list(coder.encode_all(texts))) == 400 and len(seen) > 4 * 5000 and seen.count(" often") == seen.count(" comes") == 1


def test_decoded_together(monkeypatch, spark):
    """Decoding in arrays gives what decoding alone gives, also of ids that make no text; columns follow what is asked for."""
    own = pieces.Encoder(pieces.Vocabulary.read(), 2)
    texts = ["", "one two", "", "漢é😀 ▁\n\n x\n", " ", "a" * 300, ""]
    for block in (texts, texts[:1], []):
        found = list(own.searched(block))
        got = [x for f in found for x in own.decode_all(f.ids, f.ends).to_pylist()]
        assert got == block and sum(len(f.ways) for f in found) == len(block)
    broken = np.array([own.vocabulary.byte_ids[x] for x in b" \xff\xe9a"], dtype=np.int32)
    assert own.decode_all(broken, np.array([0, 2, 4])) == pa.array([own.decode(broken[:2].tolist()), own.decode(broken[2:].tolist())])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    both = rows.select(pieces.coder(spark, 2)("t").alias("c"), pieces.coder(spark, 2, decoded=False)("t").alias("d"), "t")
    assert both.select("d.*").columns == ["ids", "scores"] and both.where("c.ids = d.ids AND c.scores = d.scores AND c.decoded = t").count() == both.where(F.col("t").isNotNull()).count() == 7


def test_ids_of_all_paths(spark):
    """The rows hold the ids of every one of the N best paths, which are those found alone and decode to the text."""
    rng = random.Random(7)
    texts = ["", " ", "\n", "a", "漢é😀 ▁\n\n x\n", "b" * 300, *(" ".join("".join(rng.choice("abthe nio") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(80))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    own = pieces.Encoder(pieces.Vocabulary.read(), 4)
    found = rows.select("t", pieces.coder(spark, 4)("t").alias("c")).select("t", "c.*").collect()
    assert len(found) == len(texts) and any(len(r["paths"]) == 4 for r in found)
    for r in found:
        assert list(zip(r["scores"], r["paths"], strict=True)) == [(s, pieces.unpacked(ids)) for s, ids in own.encode(r["t"])]
        assert r["paths"][0] == r["ids"] and {own.decode(ids) for ids in r["paths"]} == {r["t"]}
        assert len({tuple(ids) for ids in r["paths"]}) == len(r["paths"])


def test_pipeline_keeps_all_paths(spark, awkward):
    """The pipeline's last stage gives the ids of every path, and decodes them; columns of its results' names are replaced."""
    docs = awkward.withColumns({"path_ids": F.lit(1), "round_trip": F.lit("own")})
    found = corpus_pipeline.encode_pieces(spark, docs, "")
    assert set(awkward.columns) <= set(found.columns) and len(set(found.columns)) == len(found.columns)
    own = pieces.Encoder(pieces.Vocabulary.read(), 4)
    rows = found.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["round_trip"] and r["path_ids"][0] == r["piece_ids"] and len(r["path_ids"]) == len(r["path_scores"])
        assert list(zip(r["path_scores"], r["path_ids"], strict=True)) == [(s, pieces.unpacked(ids)) for s, ids in own.encode(r["text"] or "")]
