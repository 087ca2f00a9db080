"""Hard negatives from an inverted multi-index, exact by certified windows.

An anchor's positives are its best rows of the same label; the hard negatives of a positive are the best
rows of other labels whose score lies in a window below the positive's. Scores are inner products of integers, which must be below 2 ** 56.

Two codebooks, one for either half of the components, form the cells of the index: a row's cell is the pair
of its halves' nearest words. A half's score of any row of a word is at most the word's own score plus the
norm of the anchor's half times the word's radius, the greatest distance of a row's half from it; the bound of a
cell is the sum of two. An anchor visits cells by falling bound, with a heap over the two sorted lists of
half-bounds, and stops when the next bound is below what each of its windows still needs: the worst score of a
full one, the lower end of another. So the result is that of comparing all rows, whatever the codebooks.

Visits go in rounds of a growing number of rows. In a round the rows of the visited cells meet the
anchors that visit them, cell by cell; both sides are cut into blocks, so no group grows with the data, and a
vector that a third of the rows have only makes more blocks. Positives come first; their scores are the
upper ends of the windows for the same search among the other labels.

Codebooks are fitted on at most ``sample`` rows, by a hash of the id; all rows are indexed. They have the
fourth root of the number of rows as words, ``most_words`` at most, so the table of cells is bounded.

Rows with a null id or label or vector, a null component, or of another length than most take no part. Of rows that repeat
an id, the one with the least label, then vector, takes part. Without anchors, positives or rows in
a window the result is empty. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fetched, hashed_share, saved

LEAST, MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class MineSpec:
    positives: int = 5
    negatives: int = 5
    #: A negative's score is at least this share of the positive's, in hundredths, and at most the whole.
    least_share: int = 80
    #: Bound on the rows that the codebooks are fitted on, rounds of fitting, and words of a codebook.
    sample: int = 20_000
    fit_rounds: int = 10
    most_words: int = 512
    #: Rows that an anchor visits in its first round, and by how much the rounds grow.
    first: int = 4096
    growth: int = 4
    #: Rows and anchors in a group.
    block: int = 1024
    seed: int = 11


@dataclass
class MultiIndex:
    """Words of both halves, their radii, and the number of rows of each cell."""

    words: list[np.ndarray]
    radii: list[np.ndarray]
    rows: np.ndarray
    #: Whether inner products are exact in double precision.
    exact: bool

    def halves(self, v: np.ndarray) -> list[np.ndarray]:
        cut = v.shape[-1] // 2
        return [v[..., :cut].astype(np.float64), v[..., cut:].astype(np.float64)]

    def cells(self, v: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The nearest word of either half of each row, and the distances."""
        own, far = [], []
        for half, words in zip(self.halves(v), self.words, strict=True):
            square = (half * half).sum(1)[:, None] + (words * words).sum(1)[None] - 2 * half @ words.T
            own.append(square.argmin(1))
            far.append(np.sqrt(((half - words[own[-1]]) ** 2).sum(1)))
        return own, far

    def visits(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound, lower bound, cell) of the cells that have rows, by falling upper bound."""
        score, slack = [], []
        for half, words, radii in zip(self.halves(anchor), self.words, self.radii, strict=True):
            score.append(words @ half)
            slack.append(np.sqrt(half @ half) * radii)
        upper = [s + r for s, r in zip(score, slack, strict=True)]
        order = [np.argsort(-u, kind="stable") for u in upper]
        first, second = (u[o] for u, o in zip(upper, order, strict=True))
        low = [(s - r)[o] for s, r, o in zip(score, slack, order, strict=True)]
        heap = [(-(first[0] + second[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            a, b = int(order[0][i]), int(order[1][j])
            if self.rows[a, b]:
                yield -bound, low[0][i] + low[1][j], a * self.rows.shape[1] + b
            # each pair is pushed once: along the second list always, along the first from its head
            if j + 1 < len(second):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if not j and i + 1 < len(first):
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))


def usable(rows: DataFrame) -> DataFrame:
    """(id, label, v array<long>) of the rows that take part."""
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    rows = saved(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


def fit_index(rows: DataFrame, n: int, spec: MineSpec) -> tuple[MultiIndex, DataFrame]:
    """The index and its rows (id, label, v binary, cell)."""
    some = rows.where(hashed_share("id", spec.sample, n)).orderBy("id").limit(spec.sample).select("v").toPandas()["v"]
    if not len(some):
        some = rows.orderBy("id").limit(spec.sample).select("v").toPandas()["v"]
    x = np.array(some.tolist(), dtype=np.int64)
    d, rng = x.shape[1], np.random.default_rng(spec.seed)
    index = MultiIndex([], [], np.zeros((1, 1)), True)
    for half in index.halves(x):
        different = np.unique(half, axis=0)
        words = different[rng.choice(len(different), min(len(different), spec.most_words, max(1, round(n**0.25))), replace=False)]
        for _ in range(spec.fit_rounds):
            own = ((words * words).sum(1)[None] - 2 * half @ words.T).argmin(1)
            size = np.bincount(own, minlength=len(words))
            sums = np.stack([np.bincount(own, half[:, j], len(words)) for j in range(half.shape[1])], 1) if half.shape[1] else words
            words = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], words)
        index.words.append(words)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy().reshape(-1, d)
                (a, b), (x, y) = shared.value.cells(v)
                own = {"v": pa.array([r.tobytes() for r in v], pa.binary()), "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "x": pa.array(x), "y": pa.array(y), "most": pa.array(np.abs(v).max(1, initial=0).astype(np.float64))}
                yield pa.record_batch({"id": batch.column("id"), "label": batch.column("label")} | own)

    wide = len(index.words[1])
    placed = saved(rows.mapInArrow(assign, "id long, label long, v binary, a long, b long, x double, y double, most double").withColumn("cell", F.col("a") * wide + F.col("b")))
    index.rows = np.zeros((len(index.words[0]), wide), dtype=np.int64)
    index.radii = [np.zeros(len(w)) for w in index.words]
    most = 0.0
    # one row a cell, most_words ** 2 at most
    for r in fetched(placed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"), F.max("y").alias("y"), F.max("most").alias("most"))):
        index.rows[r["a"], r["b"]] = r["n"]
        for half, (word, far) in enumerate(((r["a"], r["x"]), (r["b"], r["y"]))):
            index.radii[half][word] = max(index.radii[half][word], far)
        most = max(most, r["most"])
    index.exact = most * most * d < 1 << 52
    return index, placed.select("id", "label", "v", "cell")


STATE = "id long, label long, v binary, hi array<long>, lo array<long>, seen long"


def planned(state: DataFrame, index: MultiIndex, budget: int) -> DataFrame:
    """STATE rows with ``cell``, one a cell that an anchor visits next, until ``budget`` rows or until no cell can matter."""
    shared = state.sparkSession.sparkContext.broadcast(index)

    def plan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in it:
            rows, cells, seen = [], [], []
            for i, row in enumerate(batch.to_pylist()):
                anchor, left, k, top, floor = np.frombuffer(row["v"], dtype=np.int64), budget, 0, max(row["hi"]), min(row["lo"])
                slack = 1e-9 * float(np.abs(anchor).sum() + 1) * (1 + max(float(np.abs(w).max(initial=0)) for w in at.words))
                mine: list[int] = []
                for upper, lower, cell in at.visits(anchor):
                    if upper + slack < floor or left <= 0:
                        break
                    k += 1
                    if k > row["seen"] and lower - slack <= top:
                        mine.append(cell)
                        left -= int(at.rows.flat[cell])
                rows += [i] * len(mine)
                cells += mine
                seen += [k] * len(mine)
            if rows:
                own = batch.take(pa.array(rows))
                yield pa.record_batch({c: own.column(c) for c in ("id", "label", "v", "hi", "lo")} | {"seen": pa.array(seen, pa.int64()), "cell": pa.array(cells, pa.int64())})

    return state.mapInArrow(plan, f"{STATE}, cell long")


FOUND = "anchor long, hi long, id long, score long"


def met(placed: DataFrame, visits: DataFrame, index: MultiIndex, same: bool, k: int, spec: MineSpec) -> DataFrame:
    """FOUND rows: of every block of a visited cell the best k rows in each window of each anchor.

    same: whether rows of the anchor's label count, or of other labels.
    """
    wanted = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("nq"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    grid = sizes.join(wanted, "cell").select("cell", F.ceil(F.col("n") / spec.block).cast("int").alias("vb"), F.ceil(F.col("nq") / spec.block).cast("int").alias("qb"))
    grid = F.broadcast(saved(grid))  # at most most_words ** 2 rows
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("array<long>")
    left = placed.join(grid, "cell").select("cell", part("vb").alias("a"), every("qb").alias("b"), "id", "label", "v", none.alias("hi"), none.alias("lo"))
    right = visits.join(grid, "cell").select("cell", every("vb").alias("a"), part("qb").alias("b"), "id", "label", "v", "hi", "lo")
    exact = index.exact

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ask = group["hi"].notna().to_numpy()
        out: list[tuple] = []
        if ask.any() and not ask.all():
            rows, asked = group[~ask].sort_values("id", kind="stable"), group[ask]
            x, q = (np.frombuffer(b"".join(g["v"]), dtype=np.int64).reshape(len(g), -1) for g in (rows, asked))
            score = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if exact else q @ x.T
            ids, labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
            for s, anchor, label, hi, lo in zip(score, asked["id"].tolist(), asked["label"].tolist(), asked["hi"], asked["lo"], strict=True):
                at = np.flatnonzero(((labels == label) == same) & (ids != anchor) & (s >= min(lo)) & (s <= max(hi)))
                at = at[np.argsort(-s[at], kind="stable")]
                falling = -s[at]
                for top, least in zip(hi, lo, strict=True):
                    begin = int(np.searchsorted(falling, -top, "left"))
                    for i in at[begin : min(begin + k, int(np.searchsorted(falling, -least, "right")))].tolist():
                        out.append((anchor, top, ids[i], s[i]))
        return pd.DataFrame(out, columns=["anchor", "hi", "id", "score"]).astype("int64")

    return left.unionByName(right).groupBy("cell", "a", "b").applyInPandas(one, FOUND)


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "hi").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def windows_filled(placed: DataFrame, windows: DataFrame, index: MultiIndex, same: bool, k: int, spec: MineSpec) -> DataFrame:
    """(anchor, hi, id, score, rank): the best k rows of every window of ``windows`` (id, label, v, hi, lo), certified.

    hi, lo: arrays of the windows' ends, none empty.
    """
    state, budget = windows.withColumn("seen", F.lit(0).cast("long")), spec.first
    found = None
    while True:
        visits = saved(planned(state, index, budget))
        if visits.isEmpty():
            return found if found is not None else best(placed.sparkSession.createDataFrame([], FOUND), k)
        new = met(placed, visits, index, same, k, spec)
        found = saved(best(new if found is None else found.drop("rank").unionByName(new), k))
        # a full window needs its worst score from now on
        full = found.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("hi", "score"))).alias("full"))
        on = visits.groupBy("id").agg(F.max("seen").alias("seen"))
        raised = F.transform("hi", lambda h, i: F.greatest(F.coalesce(F.try_element_at("full", h), F.lit(LEAST)), F.get("lo", i)))
        state = windows.join(on, "id").join(full.withColumnRenamed("anchor", "id"), "id", "left").withColumn("lo", F.when(F.col("full").isNull(), F.col("lo")).otherwise(raised)).select("id", "label", "v", "hi", "lo", "seen")
        budget *= spec.growth


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "vector", label: str = "label", spec: MineSpec = MineSpec()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every row that ``is_anchor``, a
    condition on ``id``, chooses. ``vector`` holds whole numbers."""
    spark = vectors.sparkSession
    rows = usable(vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[label].cast("long").alias("label"), vectors[vector].cast("array<long>").alias("v")))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index, placed = fit_index(rows, n, spec)
    anchors = saved(placed.where(is_anchor).select("id", "label", "v"))
    ends = lambda x: F.array(F.lit(x).cast("long"))
    positives = windows_filled(placed, anchors.withColumns({"hi": ends(MOST), "lo": ends(LEAST)}), index, True, spec.positives, spec)
    positives = saved(positives.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("hi")))
    # the least whole number of at least the share
    lowest = F.expr(f"transform(hi, h -> (h * {spec.least_share} + 99) div 100)")
    # a window below a negative score is empty
    tops = positives.where("hi >= 0").groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_set("hi")).alias("hi")).withColumn("lo", lowest)
    negatives = windows_filled(placed, saved(anchors.join(tops, "id")), index, False, spec.negatives, spec)
    return positives.join(negatives, ["anchor", "hi"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("hi").alias("positive_score"), F.col("score").alias("negative_score"))
