"""Linear text classifiers over hashed character n-grams scaled by naive Bayes log-count ratios.

Both classifiers share three Spark passes over a bounded, documented sample of labelled rows:
count documents a class and n-gram (partial sums a task, merged by block of the hash table), keep
the n-grams whose log-count ratio is furthest from chance, and fit a linear model over them.
Scoring is a pure map over every row and whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fetched, hashed_share, saved, text_of


@dataclass(frozen=True)
class NgramSpec:
    """orders: n-gram lengths in code points; bits: log2 of the hash table; fold: lower-case first."""

    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 20
    fold: bool = True
    #: Write a word that equals the one before it as one sign, so that repetition shows in n-grams.
    mark_repeats: bool = False
    #: n-grams kept for the linear model, and documents of the training sample with them at least.
    features: int = 1 << 14
    least_docs: int = 3
    #: Bound on the labelled rows the model is fitted on.
    sample: int = 16_000


class Grams:
    """Distinct hashed n-grams of one text, in time linear in its length."""

    def __init__(self, spec: NgramSpec):
        self.spec = spec
        self.first = np.zeros(1 << spec.bits, dtype=np.int32)

    def hashed(self, text: str) -> np.ndarray:
        spec = self.spec
        if spec.fold:
            text = text.lower()
        if spec.mark_repeats:
            words = text.split(" ")
            text = " ".join([words[0], *("\x01" if a == b else b for a, b in zip(words, words[1:], strict=False))])
        codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        out, h = [], np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, max(spec.orders) + 1):
            if n > len(codes):
                break
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1)
            if n in spec.orders:
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                out.append((mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - spec.bits))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def distinct(self, ids: np.ndarray) -> np.ndarray:
        at = np.arange(len(ids), dtype=np.int32)
        self.first[ids] = at
        return ids[self.first[ids] == at]


@dataclass
class NgramModel:
    spec: NgramSpec
    #: Weight times log-count ratio by hashed n-gram.
    table: np.ndarray
    bias: float
    #: probability = 1 / (1 + exp(-(slope * margin + shift)))
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def scorer(self, df: DataFrame) -> Callable[[Column], Column]:
        """A column function: text -> probability of label 1."""
        spec, shared = self.spec, df.sparkSession.sparkContext.broadcast((self.table, self.bias, self.slope, self.shift, self.constant))

        @F.arrow_udf("double")
        def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table, bias, slope, shift, constant = shared.value
            grams = Grams(spec)
            used = table != 0
            for texts in parts:
                out = np.empty(len(texts))
                for k, text in enumerate(texts):
                    if constant is not None:
                        out[k] = constant
                        continue
                    ids = grams.hashed(text.as_py() or "")
                    ids = grams.distinct(ids[used[ids]])
                    out[k] = slope * (bias + float(table[ids].sum(dtype=np.float64))) + shift
                yield pa.array(out if constant is not None else 1 / (1 + np.exp(-np.clip(out, -500, 500))))

        return score


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, eligible: Column, spec: NgramSpec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, text) of at most ``spec.sample`` labelled rows that are ``eligible``, chosen by a hash of the id.

    The chosen ids are at most ``spec.sample`` rows, so broadcasting them is bounded; the documents
    themselves do not move.
    """
    known = labels.where(eligible & F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    chosen = (
        known.where(hashed_share(doc_id, 2 * spec.sample, known.count()))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(spec.sample)
    )
    rows = docs.select(docs[doc_id].alias("_id"), text_of(docs, text).alias("text"))
    return rows.join(F.broadcast(chosen), "_id").select("_id", "y", "text")


def log_count_ratios(train: DataFrame, spec: NgramSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with each hashed n-gram, by class, and documents of each class (label 0, label 1).

    Each task sums its own rows; a block of the table is merged in one small group.
    """
    block = 1 << 14

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n, seen = Grams(spec), np.zeros((2, 1 << spec.bits), dtype=np.int32), [0, 0]
        for batch in it:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n[y][grams.distinct(grams.hashed(text))] += 1
                seen[y] += 1
        if sum(seen):
            ids = list(range((1 << spec.bits) // block))
            yield pa.record_batch({"block": pa.array([*ids, -1], pa.int32()), "n": pa.array([*(n[:, i * block : (i + 1) * block].tobytes() for i in ids), np.array(seen, dtype=np.int32).tobytes()], pa.binary())})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in group["n"])
        return pd.DataFrame({"block": [group["block"].iloc[0]], "n": [total.astype(np.int32).tobytes()]})

    merged = train.select("y", "text").mapInArrow(count, "block int, n binary").groupBy("block").applyInPandas(merge, "block int, n binary")
    parts = {r["block"]: np.frombuffer(r["n"], dtype=np.int32) for r in fetched(merged)}
    if not parts:
        return np.zeros(1 << spec.bits, np.int64), np.zeros(1 << spec.bits, np.int64), np.zeros(2)
    tables = np.concatenate([parts[i].reshape(2, -1) for i in range((1 << spec.bits) // block)], axis=1).astype(np.int64)
    return tables[0], tables[1], parts[-1].astype(np.float64)


def scaled_features(n0: np.ndarray, n1: np.ndarray, docs: np.ndarray, spec: NgramSpec) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the n-grams kept and their log-count ratios."""
    p, q = (n1 + 1) / (docs[1] + 2), (n0 + 1) / (docs[0] + 2)
    ratio = np.log(p / q)
    error = np.sqrt(1 / (n1 + 1) + 1 / (n0 + 1))
    strength = np.where(n0 + n1 >= spec.least_docs, np.abs(ratio) / error, 0)
    kept = np.argsort(-strength, kind="stable")[: spec.features]
    kept = np.sort(kept[strength[kept] > 0])
    return kept, ratio[kept]


def fit(train: DataFrame, spec: NgramSpec, solver: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float, float, float]]) -> NgramModel:
    """The model of ``solver`` over the kept n-grams of the labelled sample.

    solver(indptr, columns, ratios, y) gets the sample's sparse rows (bounded by ``spec.sample``
    rows) in one task and gives weights, bias, slope and shift. Without rows the score is 0; with
    one class only it is that class.
    """
    train = saved(train)
    n0, n1, docs = log_count_ratios(train, spec)
    nothing = np.zeros(1 << spec.bits, dtype=np.float32)
    if not docs.all():
        return NgramModel(spec, nothing, 0.0, constant=float(docs[1] > 0))
    kept, ratios = scaled_features(n0, n1, docs, spec)
    place = np.full(1 << spec.bits, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    shared = train.sparkSession.sparkContext.broadcast((place, ratios))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, (at, _) = Grams(spec), shared.value
        used = at >= 0
        for batch in it:
            out = []
            for text in batch.column("text").to_pylist():
                ids = grams.hashed(text)
                out.append(np.sort(at[grams.distinct(ids[used[ids]])]).tobytes())
            yield pa.record_batch({"_id": batch.column("_id"), "y": batch.column("y"), "x": pa.array(out, pa.binary())})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id", kind="stable")
        cols = [np.frombuffer(x, dtype=np.int32) for x in group["x"]]
        indptr = np.concatenate([[0], np.cumsum([len(c) for c in cols])]).astype(np.int64)
        w, bias, slope, shift = solver(indptr, np.concatenate(cols), shared.value[1], group["y"].to_numpy())
        return pd.DataFrame({"w": [np.asarray(w, dtype=np.float64).tobytes()], "bias": [bias], "slope": [slope], "shift": [shift]})

    got = train.mapInArrow(rows, "_id long, y int, x binary").withColumn("_one", F.lit("")).groupBy("_one").applyInPandas(solve, "w binary, bias double, slope double, shift double").first()
    table = nothing.copy()
    table[kept] = np.frombuffer(got["w"], dtype=np.float64) * ratios
    return NgramModel(spec, table, got["bias"], got["slope"], got["shift"])


def logistic(per_row: float = 6e-4, rounds: int = 150) -> Callable:
    """Logistic loss with a quadratic penalty of ``per_row`` times the rows, by accelerated gradient;
    the labels keep their own frequencies, so scores are probabilities."""

    def solver(indptr, cols, ratios, y):
        n, f = len(y), len(ratios)
        l2 = per_row * n
        rows = np.repeat(np.arange(n), np.diff(indptr))
        value = ratios[cols]
        w, bias = np.zeros(f), float(np.log(y.mean() / (1 - y.mean())))
        ahead, ahead_bias, t = w.copy(), bias, 1.0
        size = np.bincount(rows, value * value, n).max() + 1
        step = 1.0 / (0.25 * np.bincount(rows, value * value, n).mean() * n / 8 + l2 + size)
        last = np.inf
        for _ in range(rounds):
            z = np.bincount(rows, value * ahead[cols], n) + ahead_bias
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            loss = -np.sum(np.where(y == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))) + l2 / 2 * ahead @ ahead
            if loss > last * 1.001:  # too long a step: shorten it and forget the momentum
                step, ahead, ahead_bias, t, last = step / 2, w.copy(), bias, 1.0, np.inf
                continue
            last = loss
            g = p - y
            new, new_bias = ahead - step * (np.bincount(cols, value * g[rows], f) + l2 * ahead), ahead_bias - step * 4 * g.sum() * min(1.0, size / n)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, ahead_bias = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
            w, bias, t = new, new_bias, after
        return w, bias, 1.0, 0.0

    return solver


def hinge_dual(c: float = 0.1, epochs: int = 12, seed: int = 7) -> Callable:
    """L2-regularised hinge loss by dual coordinate descent, then Platt's sigmoid on the margins."""

    def solver(indptr, cols, ratios, y):
        n = len(y)
        sign = np.where(y == 1, 1.0, -1.0)
        parts = [cols[indptr[i] : indptr[i + 1]] for i in range(n)]
        values = [ratios[p] for p in parts]
        norm = np.array([v @ v for v in values]) + 1
        cost = np.where(y == 1, 0.5 * n / max(1, (y == 1).sum()), 0.5 * n / max(1, (y == 0).sum())) * c
        w, bias, alpha, rng = np.zeros(len(ratios)), 0.0, np.zeros(n), np.random.default_rng(seed)
        for _ in range(epochs):
            moved = 0.0
            for i in rng.permutation(n):
                p, v = parts[i], values[i]
                g = sign[i] * (float(w[p] @ v) + bias) - 1
                new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
                if new != alpha[i]:
                    d = (new - alpha[i]) * sign[i]
                    w[p] += d * v
                    bias += d
                    moved = max(moved, abs(new - alpha[i]))
                    alpha[i] = new
            if moved < 1e-4:
                break
        margin = np.array([float(w[p] @ v) for p, v in zip(parts, values, strict=True)]) + bias
        slope, shift = platt(margin, y)
        return w, bias, slope, shift

    return solver


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits the labels best (Newton's method, Platt's targets)."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g, v = p - target, p * (1 - p) + 1e-9
        h = np.array([[v @ (margin * margin) + 1e-6, v @ margin], [v @ margin, v.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([g @ margin, g.sum()]))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-9:
            break
    return float(a), float(b)
