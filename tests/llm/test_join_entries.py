"""Index entries of the Jaccard join: rare shingles first, the frequent class counted."""

from __future__ import annotations

import random

from tidewell.llm import jaccard_join as J


def entries_of(docs, spec, monkeypatch) -> list:
    kept, make = [], J.index_entries

    def watched(*args):
        out = J.saved(make(*args))
        kept.append(out)
        return out

    monkeypatch.setattr(J, "index_entries", watched)
    J.join_documents(docs, spec=spec).count()
    return kept[0].collect()


def test_chance_meetings_are_no_entries(spark, monkeypatch):
    """Documents that share a third of their words with others, less than a link needs, have no entry in common; near copies do."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passages = [[word() for _ in range(40)] for _ in range(6)]
    texts = [" ".join([word() for _ in range(80)] + passages[i % 6]) for i in range(120)]
    twin = texts[7].split()
    twin[30] = "changed"
    docs = spark.createDataFrame([*enumerate(texts), (900, " ".join(twin))], "doc_id long, text string")
    assert {r["doc"] for r in entries_of(docs, J.JoinSpec(), monkeypatch)} == {7, 900}
    got = {r["doc_id"]: r["component_id"] for r in J.join_documents(docs).collect()}
    assert got == {**{i: i for i in range(120)}, 900: 7}


def test_frequent_class_is_counted(spark, monkeypatch):
    """Few shingles reach 64 documents: they are of the frequent class however many words there are."""
    rng = random.Random(6)
    passage = " ".join(f"passage{i}" for i in range(50))
    docs = spark.createDataFrame([(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(3 + i % 3))) for i in range(150)], "doc_id long, text string")
    seen, entries = [], J.index_entries

    def watched(docs, spec, heavy, *rest):
        seen.append(len(heavy))
        return entries(docs, spec, heavy, *rest)

    monkeypatch.setattr(J, "index_entries", watched)
    for most, keys in ((60, 46), (40, 0)):
        got = J.join_documents(docs, spec=J.JoinSpec(most_heavy=most)).collect()
        assert seen.pop() == keys and {r["component_id"] for r in got} == {0} and len(got) == 150


def test_small_clusters_share_groups(spark, monkeypatch):
    """Pairs of near copies are compared some clusters to a group, and a set is made once however many rows ask for it."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame([(2 * i + k, t + " end" * k) for i, t in enumerate(texts) for k in (0, 1)], "doc_id long, text string")
    groups, make = [], J.with_sets

    def watched(need, docs, spec):
        groups.append(need.select("comp", "x", "y").distinct().count() if "x" in need.columns else 0)
        return make(need, docs, spec)

    monkeypatch.setattr(J, "with_sets", watched)
    got = {r["doc_id"]: r["component_id"] for r in J.join_documents(docs).collect()}
    assert got == {i: i - i % 2 for i in range(300)} and 0 < groups[0] <= 2
    plain = docs.selectExpr("doc_id AS _id", "text AS _text").where("_id < 4")
    asked, sets = make(spark.createDataFrame([(1, x) for x in range(5)] + [(2, 0)], "doc long, x int"), plain, J.JoinSpec())
    assert sets.count() == 2 and asked.count() == 6


def test_shingles_of_all_texts(monkeypatch):
    """Windows of texts that are hashed together stay within a text."""
    rng, hashes = random.Random(8), J.WordHashes()
    texts = ["", "a", "a b c d", "a b c d e", *(" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(60)), " "]
    want = [J.shingles(J.words_of(t), hashes, 5).tolist() for t in texts]
    for words in (1, 40, 1 << 15):
        monkeypatch.setattr(J, "BLOCK_WORDS", words)
        assert [s.tolist() for s in J.sets_of_texts(J.pa.array(texts), hashes, 5)] == want
