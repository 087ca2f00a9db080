"""LM scoring: a hidden Markov language model trained by Baum-Welch over Spark partitions.

Tokens are words (A-Z lower-cased) and one end a text. Counts over all training tokens give the
vocabulary: the most frequent tokens are symbols of the model, ``growth`` times the square root of the
number of types (``emitted`` at least, ``known`` at most), all other words are symbols by a hash of their last three
bytes, inside which a word has its smoothed relative frequency. Every round is one pass over all
training documents, cut into segments for the forward-backward recursion. A task sends the expected
counts of the symbols that it met; they are summed by block of symbols in a tree, so no group grows
with the number of tasks. Scoring is the scaled forward recursion over each whole text and is exact.

Null and empty texts are the end alone; long texts are scored whole. Rows that repeat are scored
each; a null id counts as the empty text in ``learn``. Without training rows every probability is
the smoothing's. An empty table gives an empty result. Only the id, the text and what ``learn`` reads
are used, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of, words_of

END = b""


@dataclass(frozen=True)
class HmmSpec:
    states: int = 8
    #: Symbols of their own: this times the square root of the types, but so many at least, and ``known`` at most.
    growth: float = 20.0
    emitted: int = 1 << 15
    #: Classes of the other words.
    classes: int = 1 << 10
    #: Most frequent tokens sent to every task; the counts of all others are joined by a shuffle.
    known: int = 1 << 17
    #: Rounds of training at most; they end when one raises the log-likelihood by less than this share of it.
    rounds: int = 15
    settled: float = 3e-4
    segment: int = 256
    add: float = 0.1
    #: Symbols in a block, and tasks whose sums meet in one group.
    block: int = 1 << 12
    fan: int = 64


def word_class(word: bytes, spec: HmmSpec) -> int:
    return zlib.crc32(word[-3:]) % spec.classes


def count_tokens(texts: DataFrame, spec: HmmSpec) -> DataFrame:
    """(word binary, k class, c, other): counts of all tokens of ``_text``, in rows that ``_learn`` chooses and in others."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def out():
            words, sizes = [*n[1], *n[0]], [*n[1].values(), *n[0].values()]
            return pa.record_batch({"word": pa.array(words, pa.binary()), "n": pa.array(sizes, pa.int64()), "learn": pa.array(np.arange(len(words)) < len(n[1]))})

        for batch in it:
            for text, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = n[bool(learn)]
                own.update(words_of(text))
                own[END] += 1
                if len(n[0]) + len(n[1]) > 400_000:
                    yield out()
                    n[0].clear()
                    n[1].clear()
        if n[0] or n[1]:
            yield out()

    counted = texts.select("_text", "_learn").mapInArrow(count, "word binary, n long, learn boolean").groupBy("word")
    sums = counted.agg(F.sum(F.when(F.col("learn"), F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("learn"), 0).otherwise(F.col("n"))).alias("other"))
    return sums.select("word", (F.crc32(F.substring("word", -3, 3)) % spec.classes).cast("int").alias("k"), "c", "other")


class Vocabulary:
    """The tokens sent to every task and what the smoothing needs."""

    def __init__(self, counts: DataFrame, spec: HmmSpec):
        self.spec = spec
        learnt = counts.where("c > 0")
        total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum("other").alias("m")).first()
        self.tokens, self.types = int(total["n"] or 0), int(total["v"])
        # eighths of powers of two: the largest that at most ``known`` tokens reach bounds what is collected
        step = F.floor(F.log2("c") * 8).cast("int")
        reach, least = 0, None
        for r in sorted(learnt.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"]):
            reach += r["count"]
            if reach > spec.known:
                break
            least = r["b"]
        top = sorted(learnt.where(step >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"]))) if least is not None else []
        # of the words that training hardly saw, those with a thousandth of the other rows' tokens go to
        # every task too, so that no word is frequent in the join of the rest
        often = F.col("other") > max(1000, (total["m"] or 0) // 1000)
        seen = F.col("c") > 0 if least is not None else F.lit(False)
        top += sorted(counts.where(often & ~(seen & (step >= (least or 0)))).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
        self.words = [bytes(r["word"]) for r in top]
        c = np.array([r["c"] for r in top], dtype=np.float64)
        k = np.array([r["k"] for r in top], dtype=np.int64)
        self.known = c > 0
        in_class = np.zeros((2, spec.classes))
        for r in learnt.groupBy("k").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            in_class[:, r["k"]] = r["n"], r["v"]
        #: Words that are symbols; classes come after them.
        self.emitted = own = min(max(spec.emitted, int(spec.growth * self.types**0.5)), int(self.known.sum()))
        np.subtract.at(in_class[0], k[:own], c[:own])
        np.subtract.at(in_class[1], k[:own], 1)
        self.class_mass = in_class[0] + spec.add * (in_class[1] + 1)
        self.symbol = np.where(np.arange(len(top)) < own, np.arange(len(top)), own + k).astype(np.int32)
        self.log_count = np.log10(c + spec.add)
        #: log10 of a word's probability within its class; 0 for symbols of their own
        self.inside = np.where(np.arange(len(top)) < own, 0.0, self.log_count - np.log10(self.class_mass[k]))
        self.frequency = np.concatenate([c[:own], in_class[0]]) + spec.add
        self.frequency /= self.frequency.sum()


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` (_row, _learn, _text ...) with ``symbols`` (packed int32), sums over the words sent to
    every task, and the other words with their classes and numbers; without ``_text``."""
    spec, own_symbols = vocabulary.spec, vocabulary.emitted
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.words, vocabulary.symbol, vocabulary.log_count, vocabulary.inside, vocabulary.known))
    kind = "struct<symbols: binary, n: bigint, n_common: bigint, log_count: double, inside: double, rare: array<struct<word: binary, k: int, m: int>>>"

    @F.arrow_udf(kind)
    def encoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, symbol, log_count, inside, learnt = shared.value
        place = dict(zip(words, range(len(words)), strict=True))

        def some(texts: pa.Array) -> pa.Array:
            packed, sums, ends = [], [], [0]
            rare: tuple[list[bytes], list[int], list[int]] = ([], [], [])
            for text in texts.to_pylist():
                tokens = words_of(text)
                tokens.append(END)
                at = np.fromiter(map(place.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
                ids = symbol[at] if len(symbol) else np.zeros(len(at), dtype=np.int32)
                missing = np.flatnonzero(at < 0)
                if len(missing):
                    others = [tokens[i] for i in missing.tolist()]
                    times = Counter(others)
                    own = {w: word_class(w, spec) for w in times}
                    ids[missing] = [own_symbols + own[w] for w in others]
                    for column, values in zip(rare, (own.keys(), own.values(), times.values()), strict=True):
                        column.extend(values)
                ends.append(len(rare[0]))
                known = at[at >= 0]
                packed.append(ids.tobytes())
                sums.append((len(tokens), int(learnt[known].sum()), float(log_count[known].sum()), float(inside[known].sum())))
            others_ = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(rare, (pa.binary(), pa.int32(), pa.int32()), strict=True)], ["word", "k", "m"])
            columns = [pa.array(packed, pa.binary()), *(pa.array([x[i] for x in sums], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others_)]
            return pa.StructArray.from_arrays(columns, ["symbols", "n", "n_common", "log_count", "inside", "rare"])

        for texts in parts:
            for i in range(0, len(texts), 256):
                yield some(texts[i : i + 256])

    return docs.withColumn("_e", encoded("_text")).select(*[c for c in docs.columns if c != "_text"], "_e.*")


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    #: symbols x states
    emit: np.ndarray
    #: state shares, with which a segment that is not the first begins
    share: np.ndarray

    @staticmethod
    def begin(frequency: np.ndarray, states: int, seed: int = 11) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * np.exp(0.7 * rng.standard_normal((len(frequency), states)))
        even = np.full(states, 1 / states)
        return Hmm(even, 0.9 * np.eye(states) + 0.1 / states, emit / emit.sum(0), even)

    def packed(self) -> tuple:
        return tuple(x.astype(np.float32) for x in (self.start, self.move, self.emit, self.share))


def expected_counts(sequences: list[np.ndarray], first: np.ndarray, model: tuple, sums: list[np.ndarray]) -> float:
    """Adds the expected counts of segments to ``sums`` (start, move, emit, share); their log-likelihood.

    Tokens lie place by place, those of the longest segments first, so that a step is a slice of every
    table, states are rows, and nothing is padded.
    """
    start, move, emit, share = model
    order = np.argsort([-len(x) for x in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    steps, s = int(lengths[0]), len(start)
    tokens, begins = np.concatenate([sequences[i] for i in order]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    at = np.concatenate([[0], np.cumsum(active)])
    ids = np.concatenate([tokens[begins[:n] + t] for t, n in enumerate(active)])
    seen = np.ascontiguousarray(emit[ids].T)
    alpha, scale, forward = np.empty_like(seen), np.empty(len(ids), dtype=np.float32), np.ascontiguousarray(move.T)
    at_start = first[order]
    now = np.where(at_start, start[:, None], share[:, None])
    for t in range(steps):
        here = slice(at[t], at[t + 1])
        now = (forward @ now[:, : active[t]] if t else now) * seen[:, here]
        c = now.sum(0)
        now /= c
        alpha[:, here], scale[here] = now, c
    beta = np.ones((s, len(order)), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        here, n = slice(at[t], at[t + 1]), active[t]
        if t + 1 < steps:
            next_, ahead = slice(at[t + 1], at[t + 2]), active[t + 1]
            after = seen[:, next_] * beta[:, :ahead]
            after /= scale[next_]
            sums[1] += alpha[:, at[t] : at[t] + ahead] @ after.T
            beta[:, :ahead] = move @ after
        alpha[:, here] *= beta[:, :n]
    sums[0] += alpha[:, : active[0]][:, at_start].sum(1, dtype=np.float64)
    for k in range(s):
        sums[2][:, k] += np.bincount(ids, alpha[k], len(emit))
    sums[3] += alpha.sum(1, dtype=np.float64)
    return float(np.log(scale, dtype=np.float64).sum())


def baum_welch_round(rows: DataFrame, model: Hmm, frequency: np.ndarray, spec: HmmSpec, tasks: int = 1) -> tuple[Hmm, float]:
    """One pass over the column ``symbols``: the next model, and the log-likelihood under this one.

    tasks: how many tasks read ``rows``, from which the depth of the tree of sums follows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model.packed())
    s, size, block = spec.states, len(frequency), spec.block
    kind = "block int, part int, at binary, x binary"

    def expect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = shared.value
        sums = [np.zeros(s), np.zeros((s, s)), np.zeros((size, s)), np.zeros(s)]
        waiting, firsts, held, total, any_ = [], [], 0, 0.0, False
        for batch in it:
            for packed in batch.column(0).to_pylist():
                ids = np.frombuffer(packed, dtype=np.int32)
                any_ = True
                for k in range(0, len(ids), spec.segment):
                    waiting.append(ids[k : k + spec.segment])
                    firsts.append(k == 0)
                    held += len(waiting[-1])
                if held >= 300_000:
                    total += expected_counts(waiting, np.array(firsts), given, sums)
                    waiting, firsts, held = [], [], 0
        if waiting:
            total += expected_counts(waiting, np.array(firsts), given, sums)
        if any_:
            head = np.concatenate([sums[0], (sums[1] * given[1]).ravel(), sums[3], [total]])
            met = np.flatnonzero(sums[2].any(1))
            cuts = np.searchsorted(met, np.arange(block, size, block))
            parts = [(b, at) for b, at in enumerate(np.split(met, cuts)) if len(at)]
            own = TaskContext.get().partitionId()
            yield pa.record_batch(
                {
                    "block": pa.array([-1, *(b for b, _ in parts)], pa.int32()),
                    "part": pa.array([own] * (len(parts) + 1), pa.int32()),
                    "at": pa.array([b"", *((at - b * block).astype(np.int32).tobytes() for b, at in parts)], pa.binary()),
                    "x": pa.array([head.tobytes(), *(sums[2][at].astype(np.float32).tobytes() for _, at in parts)], pa.binary()),
                }
            )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        b = int(group["block"].iloc[0])
        if b < 0:
            at, x = b"", np.sum([np.frombuffer(x) for x in group["x"]], axis=0).tobytes()
        else:
            total = np.zeros((block, s))
            for at, x in zip(group["at"], group["x"], strict=True):
                total[np.frombuffer(at, dtype=np.int32)] += np.frombuffer(x, dtype=np.float32).reshape(-1, s)
            met = np.flatnonzero(total.any(1))
            at, x = met.astype(np.int32).tobytes(), total[met].astype(np.float32).tobytes()
        return pd.DataFrame({"block": [b], "part": [int(group["part"].iloc[0])], "at": [at], "x": [x]})

    sums = rows.select("symbols").mapInArrow(expect, kind)
    while tasks > spec.fan:
        tasks = -(-tasks // spec.fan)
        sums = sums.withColumn("part", F.floor(F.col("part") / spec.fan).cast("int")).groupBy("block", "part").applyInPandas(add, kind)
    got = {r["block"]: r for r in sums.groupBy("block").applyInPandas(add, kind).collect()}
    if not got:
        return model, 0.0
    head = np.frombuffer(got.pop(-1)["x"])
    start, move, share = head[:s] + 1, head[s : s + s * s].reshape(s, s) + 1, head[s + s * s : 2 * s + s * s] + 1
    emit = np.repeat(50.0 * frequency[:, None], s, axis=1)
    for b, r in got.items():
        emit[b * block + np.frombuffer(r["at"], dtype=np.int32)] += np.frombuffer(r["x"], dtype=np.float32).reshape(-1, s)
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), share / share.sum()), float(head[-1])


def forward_log10(sequences: list[np.ndarray], model: Hmm) -> np.ndarray:
    """log10 probability of each whole sequence: the forward recursion, scaled at every step."""
    lengths = np.array([len(x) for x in sequences])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([sequences[i] for i in order])
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out, now, ones = np.zeros(len(order)), np.tile(model.start, (len(order), 1)), np.ones(len(model.start))
    ends = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    for t, n in enumerate(ends.tolist()):
        if t:
            now = now[:n] @ model.move
        now = now[:n] * model.emit[flat[offsets[:n] + t]]
        c = now @ ones
        out[:n] += np.log10(c)
        now /= c[:, None]
    back = np.empty(len(order))
    back[order] = out
    return back


def score_documents(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", spec: HmmSpec = HmmSpec()) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score (log10), one row per row of ``docs``.

    ``learn`` is a condition on ``docs`` that chooses the training rows.
    """
    rows = docs.select(docs[doc_id], learn.alias("_learn"), text_of(docs, text).alias("_text"))
    counts = saved(count_tokens(rows, spec))
    vocabulary = Vocabulary(counts, spec)
    encoded = saved(encode(rows.withColumn("_row", F.monotonically_increasing_id()), vocabulary))
    train = encoded.where("_learn").select("_row", "symbols")
    model = Hmm.begin(vocabulary.frequency, spec.states)
    tasks = (train.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    # a task sends its sums once, so four splits a task send a quarter, as long as all cores have work
    tasks = max(-(-tasks // 4), min(tasks, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    train = train.coalesce(tasks)
    before = float("-inf")
    for _ in range(spec.rounds):
        model, likelihood = baum_welch_round(train, model, vocabulary.frequency, spec, tasks)
        if likelihood - before <= spec.settled * abs(likelihood):
            break
        before = likelihood
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def forward(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for packed in parts:
            ids = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in packed]
            yield pa.array(forward_log10(ids, shared.value) if ids else np.zeros(0))

    log_mass = vocabulary.class_mass
    masses = docs.sparkSession.createDataFrame([(i, float(np.log10(x))) for i, x in enumerate(log_mass)], "k int, mass double")
    rare = encoded.select("_row", F.explode("rare").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.k").alias("k"), F.col("r.m").alias("m"))
    looked_up = rare.join(counts.where("c > 0").select("word", "c"), "word", "left").join(F.broadcast(masses), "k")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(spec.add))
    sums = looked_up.groupBy("_row").agg(F.sum(log_c * F.col("m")).alias("rare_log"), F.sum((log_c - F.col("mass")) * F.col("m")).alias("rare_inside"), F.sum(F.when(F.col("c") > 0, F.col("m"))).alias("rare_known"))
    log_z = float(np.log10(vocabulary.tokens + spec.add * (vocabulary.types + 1)))
    zero = F.lit(0.0)
    return encoded.drop("rare").join(sums, "_row", "left").select(
        doc_id,
        F.col("_learn").alias("learnt"),
        F.col("n").alias("n_tokens"),
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("log_count") + F.coalesce("rare_log", zero) - F.col("n") * F.lit(log_z)).alias("base_score"),
        (forward("symbols") + F.col("inside") + F.coalesce("rare_inside", zero)).alias("score"),
    )
