"""Repeats across documents, runs within them and hard negatives, against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import hard_negatives, repeats, runs
from tidewell.llm import queries as Q


def plain_repeats(texts, length):
    """(bytes, removed, spans, digest of the rest) of each text, from a count of all strings."""
    bodies = [(t or "").encode() for t in texts]
    times = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out.append((len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return out


def pasted(rng, alphabet, n, base):
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            i = rng.randrange(len(base) - 60)
            parts.append(base[i : i + rng.randint(5, 60)] if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize(("length", "gram", "block", "alphabet"), [(20, 8, 4096, "abcdefgh é漢"), (20, 8, 3, "ab"), (7, 7, 2, "ab"), (12, 1, 3, "abc")])
def test_repeats_against_a_count_of_strings(spark, length, gram, block, alphabet):
    rng = random.Random(length + block)
    base = "".join(rng.choice(alphabet) for _ in range(300))
    texts = [None, "", base[: length - 1], base, base, base[:length], "a" * 100, "a" * 37, "ab" * 40, *pasted(rng, alphabet, 50, base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    spec = repeats.RepeatSpec(length, gram, block, piece=64)
    got = {r[0]: tuple(r[1:]) for r in repeats.without_repeats(docs, spec=spec).collect()}
    assert got == dict(enumerate(plain_repeats(texts, length)))


def test_repeat_groups_hold_all_occurrences(spark):
    """The occurrences of a group are one string; every string that repeats lies in one of a group."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(300))
    texts = [base[:80], base[40:120], base[:30] + base[60:140], *pasted(rng, "abcdefgh", 20, base)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spec = repeats.RepeatSpec(20, 8)
    rows = repeats.repeat_groups(repeats.find_repeats(docs, spec=spec), spec).collect()
    body = {hashlib.sha256(t.encode()).digest()[:16]: t.encode() for t in texts}
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r["repeat"]].add((bytes(r["key"]), r["start"], r["length"]))
    held = collections.defaultdict(set)
    for members in groups.values():
        strings = {body[k][s : s + n] for k, s, n in members}
        assert len(strings) == 1 and len(members) > 1
        for k, s, n in members:
            held[k] |= {body[k][i : i + 20] for i in range(s, s + n - 19)}
    times = collections.Counter(b[i : i + 20] for b in body.values() for i in range(len(b) - 19))
    for k, b in body.items():
        assert {s for i in range(len(b) - 19) if times[s := b[i : i + 20]] > 1} <= held[k]


def test_repeats_of_awkward_tables(spark, awkward, nothing):
    """Null and repeated ids are rows of their own; copies of long texts are repeats as a whole."""
    rows = awkward.select("doc_id", "text").collect()
    got = repeats.without_repeats(awkward).collect()
    want = collections.Counter((r["doc_id"], *w) for r, w in zip(rows, plain_repeats([r["text"] for r in rows], 200), strict=True))
    assert collections.Counter(map(tuple, got)) == want
    assert repeats.without_repeats(nothing).count() == 0


def plain_runs(w, shortest=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(shortest, 2 * p) and i > s:
                out.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


@pytest.mark.parametrize("pairs", [10, 1 << 18])
def test_runs_against_all_periods(pairs):
    rng = random.Random(pairs)
    for _ in range(30):
        texts = []
        for _ in range(rng.randint(1, 8)):
            t = []
            for _ in range(rng.randint(0, 6)):
                unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 45]))]
                t += (unit * rng.randint(1, 9))[: rng.randint(1, 200)] if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
            texts.append([x.encode() for x in t])
        texts.sort(key=len, reverse=True)
        size = np.array([len(t) for t in texts])
        start, end, period = runs.runs_of(runs.numbered(texts), np.repeat(np.arange(len(texts), dtype=np.int32), size), runs.RunSpec(pairs=pairs))
        base = np.concatenate([[0], np.cumsum(size)])
        for k, t in enumerate(texts):
            own = (start >= base[k]) & (start < base[k + 1])
            assert list(zip((start[own] - base[k]).tolist(), (end - start)[own].tolist(), period[own].tolist(), strict=True)) == plain_runs(t)


def plain_run_row(i, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
    drop = {k for s, size, p in found for k in range(s + p, s + size)}
    lines, kept = "".join(f"{s},{size},{p}\n" for s, size, p in found), b" ".join(x for k, x in enumerate(w) if k not in drop)
    return (i, len(found), *best, best[1] * 1000 // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_query_against_all_periods(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in Q.table(spark, sf, "documents").collect()}
    rows = [tuple(r) for r in Q.op12_periodic_runs(spark, sf).select(COLUMNS).collect() if len((texts[r["doc_id"]] or "").split()) < 2000]
    assert len(rows) > 100 and rows == [plain_run_row(r[0], texts[r[0]]) for r in rows]


def test_runs_of_awkward_tables(spark, awkward, nothing):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "x " * 40_000), (2, "x " * 40_000), (3, "a b\t" * 6), (4, "a b " * 5 + "a"), (5, " é " * 30)], "doc_id long, text string")
    got = {r[0]: r for r in runs.with_runs(docs).collect()}
    assert (got[2]["_tw_runs"], got[2]["_tw_start"], got[2]["_tw_length"], got[2]["_tw_period"]) == (1, 0, 40_000, 1)
    assert [got[k]["_tw_runs"] for k in (None, 1, 3, 4, 5)] == [0, 0, 1, 0, 1] and got[1]["_tw_start"] is None
    assert {r["_tw_id"]: r["_tw_text"] for r in runs.collapsed(docs).collect()}[3] == "a b"
    assert runs.with_runs(awkward).count() == awkward.count() and runs.with_runs(nothing).count() == 0


def plain_negatives(rows, anchors):
    """Rows of (id, label, v), one an id."""
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    out = []
    for i, label, v in rows:
        if i in anchors:
            scores = sorted((-dot(v, u), j, k) for j, k, u in rows if j != i)
            for s, j, _ in [x for x in scores if x[2] == label][:5]:
                window = [x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
                out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("large", [1, 1 << 23])
def test_hard_negatives_against_all_rows(spark, large):
    """Ties, repeated vectors, rows that take no part, small rounds and blocks; scores beyond double precision."""
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(-9, 10, (150, 6)), np.tile(rng.integers(-9, 10, (1, 6)), (80, 1)), np.zeros((3, 6), dtype=np.int64)]) * large
    rows = [(i, int(rng.integers(0, 3)), x.tolist()) for i, x in enumerate(v)]
    odd = [(None, 1, [1] * 6), (900, None, [1] * 6), (901, 1, None), (902, 1, [1, 2, None, 4, 5, 6]), (903, 1, [1, 2]), (5, 9, [7] * 6), rows[7]]
    table = spark.createDataFrame([(*r, "x") for r in [*rows, *odd]], "vec_id long, label int, vector array<long>, score string")
    anchors = {0, 5, 40, 150, 151, 232}
    spec = hard_negatives.MineSpec(first=20, growth=2, block=16)
    got = hard_negatives.mine(table, F.col("id").isin(*anchors), spec=spec)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, anchors)
    assert hard_negatives.mine(table.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine(table, F.col("id") == -1).count() == 0


def test_cells_are_visited_by_falling_bounds_that_hold():
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (400, 8))
    index = hard_negatives.MultiIndex([v[:7, :4].astype(float), v[:9, 4:].astype(float)], [np.zeros(7), np.zeros(9)], np.zeros((7, 9), dtype=np.int64), True)
    (a, b), far = index.cells(v)
    for half, own in enumerate((a, b)):
        np.maximum.at(index.radii[half], own, far[half])
    np.add.at(index.rows, (a, b), 1)
    for anchor in v[:20]:
        order = list(index.visits(anchor))
        assert len(order) == len({c for _, _, c in order}) == (index.rows > 0).sum()
        assert all(x[0] >= y[0] - 1e-6 for x, y in zip(order, order[1:], strict=False))
        score = v @ anchor
        for upper, lower, cell in order:
            own = score[a * 9 + b == cell]
            assert own.max() <= upper + 1e-6 and own.min() >= lower - 1e-6
