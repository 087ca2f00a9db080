"""Dedup, near duplicates, mixing, pieces and the language model on awkward tables."""

from __future__ import annotations

import collections
import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup as D
from tidewell.llm import hmm, mixing, pieces
from tidewell.llm import jaccard_join as J
from tidewell.llm.components import components


def test_duplicates(spark, awkward, nothing):
    rows = awkward.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    want = sorted((str(r["doc_id"]), str(max((i for i in groups[r["text"] or ""] if i is not None), default=None)), len(groups[r["text"] or ""])) for r in rows)
    for most in (1 << 28, 1 << 14):  # one filter, and four slices
        got = D.duplicate_table(awkward, most_bits=most).collect()
        assert sorted((str(r["_tw_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
        kept = D.exact_dedup(awkward, most_bits=most)
        assert kept.columns == awkward.columns and kept.count() == len(groups)
        assert sorted(r["text"] or "" for r in kept.collect()) == sorted(groups)
    assert D.exact_dedup(nothing).count() == 0 and D.duplicate_table(nothing).count() == 0


def test_filter_has_no_misses(spark):
    h = spark.range(3000).select(F.xxhash64(F.col("id") % 2500).alias("h"))
    maybe, _ = D.repeated_filter(h, D.slicing(3000, 1 << 28)[0])
    counted = h.withColumn("m", maybe(F.col("h"))).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("m"))
    assert counted.where("n > 1 and not m").count() == 0
    assert counted.where("n = 1 and m").count() < 200


def test_filter_holds_one_slice_at_a_time(spark, monkeypatch):
    """Sixteen slices: every table has an eighth of a KB, and at most one is alive when the next is made."""
    keyed = D.saved(spark.range(4000).select(F.col("id").alias("_tw_id"), F.sha2((F.col("id") % 3500).cast("string"), 256).alias("_tw_sha")).withColumn("_tw_h", F.xxhash64("_tw_sha")))
    alive, most, sizes, make = set(), [0], [], D.repeated_filter

    def watched(hashes, bits):
        maybe, table = make(hashes, bits)
        sizes.append(table.value.nbytes)
        alive.add(id(table))
        most[0] = max(most[0], len(alive))
        end = table.destroy
        table.destroy = lambda *a: (alive.discard(id(table)), end(*a))
        return maybe, table

    monkeypatch.setattr(D, "repeated_filter", watched)
    got = D.flagged(keyed, 4000, 1 << 12)
    assert most[0] == 1 and not alive and len(sizes) == 16 and set(sizes) == {(1 << 12) // 8}
    n = got.groupBy("_tw_sha").agg(F.count(F.lit(1)).alias("n"), F.min("_tw_maybe").alias("m"))
    assert got.count() == 4000 and n.where("n > 1 and not m").count() == 0 and n.where("n = 1 and m").count() < 300


def plain_components(rows: list[tuple], percent: int = 80) -> dict:
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        for s, t in itertools.product(sets[a], sets[b]):
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (max(map(len, sets[i])), find(i)) for i in sets}


@pytest.mark.parametrize(("heavy", "crowd"), [(64, 64), (2, 64), (2, 2)])
def test_join_against_all_pairs(spark, awkward, monkeypatch, heavy, crowd):
    """With ``heavy=2`` every shared shingle is of the frequent class; with a crowd of 2 all is compared in blocks."""
    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "GROUP", 1 << 17 if crowd > 2 else 300)
    rng = random.Random(heavy)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for n in (3, 5, 8, 11, 14, 30, 80, 200):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                copy[rng.randrange(n)] = rng.choice(vocabulary)
            texts.append(" ".join(copy + (passage if rng.random() < 0.2 else [])))
    made = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(made)
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()])
    got = J.join_documents(docs, spec=J.JoinSpec(heavy=heavy)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (want[r["doc_id"]] if r["doc_id"] is not None else (0, None)), r


def test_slices_read_their_own_folder(spark):
    keyed = spark.range(3000).select(F.col("id").alias("_tw_id"), F.sha2(F.col("id").cast("string"), 256).alias("_tw_sha")).withColumn("_tw_h", F.xxhash64("_tw_sha"))
    slices = D.by_slice(keyed, 16)
    files = [{r["f"] for r in own.select(F.input_file_name().alias("f")).distinct().collect()} for own in slices]
    assert sum(own.count() for own in slices) == 3000 and all(own.columns == keyed.columns for own in slices)
    assert sum(map(len, files)) == len(set().union(*files)) and all("PartitionFilters: [isnotnull(_tw_slice" in own._jdf.queryExecution().toString() for own in slices)


def test_join_of_nothing(nothing):
    assert J.join_documents(nothing).count() == 0 and J.one_of_each(nothing).count() == 0


def test_one_of_each_keeps_columns(awkward):
    kept = J.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 6 in ids and not {7, 8, 9, 10, 11} & set(ids) and ids.count(None) == 2


def test_components_of_a_chain(spark):
    n = 70
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[501] == 500


def test_mixing(spark, awkward, nothing):
    docs = awkward.withColumn("topic", F.lit(None).cast("string"))
    mixed = mixing.mix(docs, alpha=0.0, keep=0.5, rounds=30)
    assert mixed.count() == docs.count()
    shares = mixed.groupBy(F.coalesce("source", F.lit("-"))).agg(F.sum(F.col("_tw_tokens") * F.col("_tw_weight")).alias("t")).collect()
    total = sum(r["t"] for r in shares)
    assert all(math.isclose(r["t"] / total, 1 / len(shares), rel_tol=1e-3) for r in shares)
    sums = mixed.agg(F.sum(F.col("_tw_tokens") * F.col("_tw_prob")).alias("kept"), F.sum("_tw_tokens").alias("n")).first()
    assert math.isclose(sums["kept"] / sums["n"], 0.5, rel_tol=0.01)
    assert mixing.mix(nothing.withColumn("topic", F.lit("t"))).count() == 0
    given = mixing.mix(docs, targets={"source": {"a": 1.0, "zz": 3.0}}, keep=0.9).where("source = 'b'").select(F.max("_tw_prob")).first()[0]
    assert given == 0.0
    assert mixing.keep_sampled(awkward, mixed).columns == awkward.columns


def test_pieces_against_all_paths():
    """Scores and pieces of the five best paths, by the list of all paths; paths of equal score may come in any order."""
    v = pieces.Vocabulary.read()
    rng = random.Random(1)

    def every(text):
        s, out = pieces.BLANK + text.replace(" ", pieces.BLANK), []

        def go(a, score, ids):
            if a == len(s):
                out.append((round(score, 6), ids))
            for b in range(a + 1, min(len(s), a + 16) + 1):
                got = v.pieces.get(s[a:b])
                if got or b == a + 1:
                    own = (got[0],) if got else tuple(v.byte_ids[x] for x in s[a].replace(pieces.BLANK, " ").encode())
                    go(b, score + (got[1] if got else v.unknown), ids + own)

        go(0, 0.0, ())
        return sorted(out, key=lambda x: -x[0])

    for _ in range(60):
        text = "".join(rng.choice("abthe nio\né") for _ in range(rng.randint(1, 9)))
        want = every(text)
        got = [(round(s, 6), tuple(pieces.unpacked(ids))) for s, ids in pieces.Encoder(v, 5).encode(text)]
        assert [s for s, _ in got] == [s for s, _ in want[:5]] and len(set(got)) == len(got) and set(got) <= set(want), text
        if len(want) > 1 and want[0][0] > want[1][0]:
            assert got[0] == want[0]


def test_units_give_what_the_whole_lattice_gives():
    """A-star over a longer text as one lattice finds the scores that the units' paths combine to."""
    v = pieces.Vocabulary.read()
    for text in ("the best of the rest", "a b c d e f", "no one is on\nthe other side", "é è the"):
        whole = pieces.Vocabulary(v.pieces, v.texts, v.byte_ids)
        joined = [s for s, _ in _whole_paths(whole, text, 6)]
        assert np.allclose([s for s, _ in pieces.Encoder(v, 6).encode(text)], joined)


def _whole_paths(v, text, most):
    """A-star over the lattice of the whole text, blanks within pieces forbidden as the vocabulary has none."""
    s = pieces.BLANK + text.replace(" ", pieces.BLANK)
    best, ending = [0.0] + [float("-inf")] * len(s), [[] for _ in range(len(s) + 1)]
    for a in range(len(s)):
        for b in range(a + 1, min(len(s), a + 20) + 1):
            got = v.pieces.get(s[a:b]) if pieces.BLANK not in s[a + 1 : b] else None
            if got or b == a + 1:
                x = got[1] if got else v.unknown
                ending[b].append((a, x))
                best[b] = max(best[b], best[a] + x)
    heap, out = [(-best[-1], len(s), 0.0, ())], []
    while heap and len(out) < most:
        _, at, behind, cuts = heapq.heappop(heap)
        if not at:
            out.append((behind, cuts))
        for a, x in ending[at]:
            heapq.heappush(heap, (-(behind + x + best[a]), a, behind + x, (a, *cuts)))
    return out


def test_pieces_round_trip(spark, awkward, nothing):
    paths = awkward.select("text", pieces.encoder(spark, 3)(F.coalesce("text", F.lit(""))).alias("p"))
    back = paths.select("text", *[pieces.decoder(spark)(F.try_element_at("p", F.lit(i))["ids"]).alias(f"t{i}") for i in (1, 2, 3)], F.size("p").alias("n")).collect()
    for r in back:
        assert all(r[f"t{i}"] == (r["text"] or "") for i in range(1, r["n"] + 1))
    coded = awkward.select(F.coalesce("text", F.lit("")).alias("t"), pieces.coder(spark, 3)(F.coalesce("text", F.lit(""))).alias("c"), pieces.encoder(spark, 3)(F.coalesce("text", F.lit(""))).alias("p")).collect()
    assert all(r["c"]["decoded"] == r["t"] and r["c"]["ids"] == r["p"][0]["ids"] and r["c"]["scores"] == [x["score"] for x in r["p"]] for r in coded)
    assert nothing.select(pieces.encoder(spark)("text").alias("p")).count() == 0


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    model = hmm.Hmm(*(x / x.sum(-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)))), (lambda e: e / e.sum(0))(rng.random((5, 3))), np.full(3, 1 / 3))
    seqs = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 4, 6, 3)]
    for got, s in zip(hmm.forward_log10(seqs, model), seqs, strict=True):
        want = sum(model.start[p[0]] * model.emit[s[0], p[0]] * math.prod(model.move[p[t - 1], p[t]] * model.emit[s[t], p[t]] for t in range(1, len(s))) for p in itertools.product(range(3), repeat=len(s)))
        assert math.isclose(got, math.log10(want), rel_tol=1e-9)
    sums = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), np.zeros(3)]
    total = hmm.expected_counts(seqs, np.ones(4, bool), model.packed(), sums)
    assert math.isclose(total / math.log(10), sum(hmm.forward_log10(seqs, model)), rel_tol=1e-4)
    moves = sums[1] * model.move
    assert math.isclose(sums[2].sum(), 14, rel_tol=1e-4) and math.isclose(moves.sum(), 10, rel_tol=1e-4) and math.isclose(sums[0].sum(), 4, rel_tol=1e-4)


def test_language_model(spark, awkward, nothing):
    small = hmm.HmmSpec(states=2, emitted=64, classes=16, known=128, sample_rounds=2, rounds=2)
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 0
    got = hmm.score_documents(awkward, learn, spec=small).collect()
    assert len(got) == awkward.count()
    c = collections.Counter()
    for r in awkward.where(learn).collect():
        c.update((r["text"] or "").encode().lower().split() + [b""])
    n = sum(c.values())
    by = {}
    for r in awkward.collect():
        w = (r["text"] or "").encode().lower().split() + [b""]
        by.setdefault(r["doc_id"], []).append((len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w)))
    for r in got:
        assert any(r["n_tokens"] == t and r["n_known"] == k and math.isclose(r["base_score"], b, rel_tol=1e-9) for t, k, b in by[r["doc_id"]])
        assert r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"])
    assert hmm.score_documents(nothing, learn, spec=small).count() == 0
    assert hmm.score_documents(awkward, F.lit(False), spec=small).where("train_tokens = 0 and n_known = 0").count() == awkward.count()


def test_round_raises_likelihood(spark, awkward):
    spec = hmm.HmmSpec(states=3, emitted=64, classes=16, known=128)
    rows = awkward.select(F.coalesce("text", F.lit("")).alias("_text"), F.lit(True).alias("_learn"))
    vocabulary = hmm.Vocabulary(hmm.count_tokens(rows, spec), spec)
    encoded = hmm.encode(rows, vocabulary).select("symbols").cache()
    model, last = hmm.Hmm.begin(vocabulary.frequency, 3), []
    for _ in range(5):
        model, likelihood = hmm.baum_welch_round(encoded, model, vocabulary.frequency, spec)
        last.append(likelihood)
    assert all(b >= a - 1e-3 * abs(a) for a, b in zip(last[1:], last[2:], strict=False)) and last[-1] > last[0]
    assert math.isclose(model.emit.sum(), 3, rel_tol=1e-6)
