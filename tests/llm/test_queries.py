"""The registered queries and the pipeline on the smallest tables, against SQL where there is some."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import pieces
from tidewell.llm import queries as Q

from test_texts import plain_components


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, name):
    got = Q.queries()[name](spark, sf).toPandas()
    sql = Q.oracle_sql().get(name)
    source = {"op8_nearest_neighbours": None, "op11_hard_negatives": None, "op9_html_extraction": "pages", "op10_url_filters": "pages"}.get(name, "documents")
    if source:
        assert len(got) == spark.read.parquet(f"{sf}/{source}.parquet").count()
    if sql:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.sql(sql).df()
        key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(str).values.tolist()))
        assert key(got) == key(want)


def plain_sample(rows, topics, alpha, keep):
    """The ids that raking and calibrated sampling keep, by loops over cells."""
    topic = {}
    for t in topics:
        topic[t["vec_id"]] = min(topic.get(t["vec_id"], str(t["label"])), str(t["label"]))
    cell = {r["doc_id"]: (r["source"], r["lang"], topic.get(r["doc_id"])) for r in rows}
    n = collections.Counter()
    for r in rows:
        n[cell[r["doc_id"]]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    total = sum(n.values())
    share = []
    for d in range(3):
        own = collections.Counter()
        for c, x in n.items():
            own[c[d]] += x
        raw = {k: (x / total) ** alpha for k, x in own.items() if x}
        share.append({k: x / sum(raw.values()) for k, x in raw.items()})
    raked = {c: x / total for c, x in n.items()}
    for _ in range(12):
        for d in range(3):
            have = collections.Counter()
            for c, x in raked.items():
                have[c[d]] += x
            raked = {c: x * share[d].get(c[d], 0) / have[c[d]] if have[c[d]] else 0.0 for c, x in raked.items()}
    weight = {c: raked[c] * total / x for c, x in n.items() if x}
    scale = keep
    for _ in range(12):
        left = keep * total - sum(n[c] for c, w in weight.items() if scale * w >= 1)
        some = sum(w * n[c] for c, w in weight.items() if scale * w < 1)
        if left <= 0 or not some:
            break
        scale = left / some
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) / (1 << 48)
    return {i for i, c in cell.items() if draw(i) < (min(1.0, scale * weight[c]) if c in weight else 1.0)}


def test_stages_on_an_awkward_table(spark, sf, awkward, nothing):
    """Nulls, repeated rows, clashing and further columns, and no rows at all."""
    docs = awkward.withColumns({"n_chars": F.lit(1), "piece_ids": F.lit("own"), "n_pieces": F.lit(0), "_x": F.lit("further")})
    for empty in (False, True):
        rows = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            before = rows.count()
            rows = corpus_pipeline.saved(stage(spark, rows, sf))
            columns = rows.columns
            assert len(set(columns)) == len(columns) and "_x" in columns and rows.count() <= before and (rows.count() > 0) == (not empty), name
        assert set(docs.columns) <= set(columns) and columns[-3:] == ["piece_ids", "n_pieces", "path_scores"]
        texts = [r["text"] or "" for r in rows.collect()]
        assert len(texts) == len(set(texts))
        assert rows.where("size(piece_ids) != n_pieces").count() == 0


def test_pipeline(spark, sf):
    """Each stage against a plain version over its own input."""
    docs = Q.table(spark, sf, "documents")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.saved(stage(spark, docs, sf))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.columns[: len(columns)] == columns
        if name == "exact dedup":
            best = collections.defaultdict(int)
            for i, r in before.items():
                best[r["text"]] = max(best[r["text"]], i)
            assert set(after) == set(best.values())
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in Q.table(spark, sf, "labels").collect()}
            wrong = sum((i not in after) != bool(y) for i, y in labels.items() if i in before)
            assert wrong <= 0.15 * len(labels)
        if name.startswith("n-gram"):
            component = {i: c for i, (_, c) in plain_components([(i, r["text"]) for i, r in before.items()]).items()}
            assert set(after) == {i for i, c in component.items() if i == c}
        if name.startswith("mixing"):
            assert set(after) == plain_sample(before.values(), spark.read.parquet(f"{sf}/embeddings.parquet").collect(), corpus_pipeline.ALPHA, corpus_pipeline.KEEP)
        if name.startswith("Sentence"):
            assert set(after) == set(before) and all(len(r["piece_ids"]) == r["n_pieces"] and math.isfinite(r["path_scores"][0]) for r in after.values())
            coder = pieces.Encoder(pieces.Vocabulary.read(), 4)
            for r in list(after.values())[:40]:
                paths = coder.encode(r["text"] or "")
                assert coder.decode(r["piece_ids"]) == (r["text"] or "") and r["piece_ids"] == pieces.unpacked(paths[0][1]) and r["path_scores"] == [x for x, _ in paths]
    assert docs.where(F.col("n_pieces") == 0).count() == docs.where("coalesce(text, '') = ''").count()
