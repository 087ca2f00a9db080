"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Vectors get one more coordinate that makes all norms equal, so that the largest inner product is the
smallest distance; then they are rotated at random, once, and stored by list (nearest of the k-means
centres) in column blocks of single precision, beside the original. A query scans the lists whose
centres are nearest; how many is measured on the sample: as many as hold the share ``reach`` of the
true neighbours of ``trials`` sampled queries. It scans them column block by column block; after each block a hypothesis test on the partial distance abandons candidates that are very
unlikely to be nearer than the query's present k-th. What remains is scored exactly, in double
precision, on the original vectors. The nearest list is scanned first and gives every query its
first k-th score, which all other lists use.

Lists and the queries of a list are cut into blocks, so no group grows with the data. Of equal
vectors only the k + 1 with the smallest ids can be among any k nearest, as ties go to the smaller
id, so only those are stored. Centres are fitted on at most ``sample`` vectors, by a hash of the id.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows with a null id; of rows that repeat an id and a vector one takes part, and a
query is not its own candidate whichever of its rows it is. Other columns are not read. Without
vectors the result is empty; with fewer candidates than k all are given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_share, saved

RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class AnnSpec:
    k: int = 20
    #: Lists: about this times the square root of the number of vectors, ``most_lists`` at most.
    density: float = 0.3
    most_lists: int = 4096
    #: Share of the true neighbours that the scanned lists hold, by the brute-force neighbours of so many
    #: sampled queries in the sample; and the least number of lists. Clustered vectors need few lists,
    #: vectors without any structure well over half of them.
    reach: float = 0.97
    trials: int = 256
    least_probe: int = 4
    #: Bound on the vectors that the centres are fitted on.
    sample: int = 20_000
    rounds: int = 10
    #: Vectors and queries in a group.
    block: int = 1024
    #: Width of a column block.
    columns: int = 16
    #: Deviations by which a partial distance must be too large for a candidate to be abandoned.
    slack: float = 2.1
    seed: int = 5


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part, repeated rows once."""
    v = F.col("v")
    good = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v")).where(F.col("id").isNotNull() & good)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0)).dropDuplicates(["id", "v"])


def _matrix(column, d: int) -> np.ndarray:
    """A packed column or one of arrays as a matrix."""
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, d)


@dataclass
class Index:
    rotation: np.ndarray
    centres: np.ndarray
    #: The common squared norm of the lengthened vectors.
    norm: float
    #: Lists that a query scans.
    probes: int = 1

    def place(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))
        return np.concatenate([x, extra[:, None]], 1) @ self.rotation

    def ask(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], 1) @ self.rotation

    def nearest(self, y: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres * self.centres).sum(1)[None] - 2 * y @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def fit_index(base: DataFrame, n: int, spec: AnnSpec) -> Index:
    norm = float(base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    rows = base.where(hashed_share("id", spec.sample, n)).orderBy("id").limit(spec.sample).select("v").toPandas()["v"]
    if not len(rows):
        rows = base.orderBy("id").limit(spec.sample).select("v").toPandas()["v"]
    x = np.array(rows.tolist(), dtype=np.float64)
    rng = np.random.default_rng(spec.seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1] + 1,) * 2))
    index = Index(rotation, np.zeros((1, x.shape[1] + 1)), norm)
    y = np.unique(index.place(x), axis=0)
    lists = min(spec.most_lists, len(y), max(1, round(spec.density * np.sqrt(n))))
    index.centres = y[np.sort(rng.choice(len(y), lists, replace=False))]
    for _ in range(spec.rounds):
        own = np.concatenate([index.nearest(y[i : i + 2048], 1)[:, 0] for i in range(0, len(y), 2048)])
        size = np.bincount(own, minlength=lists)
        sums = np.stack([np.bincount(own, y[:, j], lists) for j in range(y.shape[1])], 1)
        index.centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], index.centres)
    index.probes = max(min(lists, spec.least_probe), measured_probes(index, x, rng.choice(len(x), min(len(x), spec.trials), replace=False), spec))
    return index


def measured_probes(index: Index, x: np.ndarray, trials: np.ndarray, spec: AnnSpec) -> int:
    """How many of its nearest lists a query needs for the share ``reach`` of its true neighbours in ``x``."""
    lists, k = len(index.centres), min(spec.k, len(x) - 1)
    if spec.reach >= 1 or k < 1:
        return lists
    own = np.concatenate([index.nearest(index.place(x[i : i + 2048]), 1)[:, 0] for i in range(0, len(x), 2048)])
    order = index.nearest(index.ask(x[trials]), lists)
    position = np.empty_like(order)
    np.put_along_axis(position, order, np.arange(lists)[None, :], 1)
    places = []
    for row, t in enumerate(trials):
        score = x @ x[t]
        score[t] = -np.inf
        places.append(position[row, own[np.argpartition(-score, k - 1)[:k]]])
    return int(np.quantile(np.concatenate(places), spec.reach, method="higher")) + 1


def blocks_of(d: int, spec: AnnSpec) -> list[int]:
    """Borders of the column blocks of a lengthened vector."""
    return [*range(0, d + 1, spec.columns), d + 1]


def in_blocks(y: np.ndarray, cuts: list[int]) -> dict[str, list[bytes]]:
    """Rotated vectors as packed columns ``y0, y1, ...``, one a column block."""
    y = y.astype(np.float32)
    return {f"y{c}": [r.tobytes() for r in np.ascontiguousarray(y[:, a:b])] for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}


def scan(x: np.ndarray, y: list[np.ndarray], ids: np.ndarray, q: np.ndarray, z: list[np.ndarray], asked: np.ndarray, floor: np.ndarray, norm: float, spec: AnnSpec) -> tuple[pd.DataFrame, int]:
    """Of one block, the best k candidates of each query that reach its ``floor``, and the components read.

    x, q: candidates and queries; y, z: the same rotated, by column block; floor: the score to reach,
    -inf for any.
    """
    width = [c.shape[1] for c in y]
    cuts, d = np.concatenate([[0], np.cumsum(width)]), sum(width)
    norms, z_norms = [(c * c).sum(1) for c in y], np.stack([(c * c).sum(1) for c in z], 1)
    limit = (q * q).sum(1) + norm - 2 * floor
    first = z_norms[:, :1] + norms[0][None] - 2 * z[0] @ y[0].T
    read = first.size * width[0]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(len(asked)):
        alive, far = np.flatnonzero(ids != asked[at]), first[at]
        far = far[alive]
        for c in range(1, len(y)):
            if not np.isfinite(limit[at]) or not len(alive):
                break
            # the partial distance scaled to all dimensions strays from the whole one by about the
            # square root of what is left over the dimensions seen
            seen = cuts[c]
            keep = far * (d / seen) <= limit[at] * (1 + spec.slack * np.sqrt((1 - seen / d) / seen)) ** 2
            alive, far = alive[keep], far[keep]
            far = far + z_norms[at, c] + norms[c][alive] - 2 * y[c][alive] @ z[c][at]
            read += len(alive) * width[c]
        score = (x[alive] * q[at]).sum(1)
        read += len(alive) * x.shape[1]
        keep = np.flatnonzero(score >= floor[at])
        keep = keep[np.lexsort((ids[alive[keep]], -score[keep]))[: spec.k]]
        out.append((np.full(len(keep), asked[at]), ids[alive[keep]], score[keep]))
    return pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("query_id", "vec_id", "score"))}), read


def scan_lists(stored: DataFrame, asked: DataFrame, sizes: DataFrame, index: Index, d: int, spec: AnnSpec, read: Accumulator | None = None) -> DataFrame:
    """RESULT rows of ``asked`` (id, v, y0, ..., list, floor) against ``stored`` (id, v, y0, ..., list), list by list.

    A list of many vectors or queries is cut both ways: each block of vectors meets each of queries.
    """
    norm, columns = index.norm, [f"y{c}" for c in range(len(blocks_of(d, spec)) - 1)]
    wanted = asked.groupBy("list").agg(F.count(F.lit(1)).alias("nq"))
    grid = sizes.join(wanted, "list").select("list", F.ceil(F.col("n") / spec.block).cast("int").alias("vb"), F.ceil(F.col("nq") / spec.block).cast("int").alias("qb"))
    grid = F.broadcast(saved(grid))  # at most ``most_lists`` rows
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = stored.join(grid, "list").select("list", part("vb").alias("a"), every("qb").alias("b"), "id", "v", *columns, F.lit(None).cast("double").alias("floor"), F.lit(False).alias("ask"))
    right = asked.join(grid, "list").select("list", every("vb").alias("a"), part("qb").alias("b"), "id", "v", *columns, "floor", F.lit(True).alias("ask"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ask = group["ask"].to_numpy()
        if ask.all() or not ask.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x, q = _matrix(group["v"][~ask], d), _matrix(group["v"][ask], d)
        y, z = ([np.frombuffer(b"".join(group[c][of]), dtype=np.float32).reshape(int(of.sum()), -1) for c in columns] for of in (~ask, ask))
        ids = group["id"].to_numpy(dtype=np.int64)
        found, n = scan(x, y, ids[~ask], q, z, ids[ask], group["floor"][ask].to_numpy(dtype=np.float64), norm, spec)
        if read is not None:
            read.add(n)
        return found

    return left.unionByName(right).groupBy("list", "a", "b").applyInPandas(one, RESULT)


def best(rows: DataFrame, k: int) -> DataFrame:
    """rows with their rank by query, the first k only."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", spec: AnnSpec = AnnSpec(), read: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found of every row that ``is_query`` (a condition on ``id``) chooses.

    read: counts the vector components that scans read, for measurements.
    """
    spark = vectors.sparkSession
    base = saved(usable(vectors, vec_id, vector))
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit_index(base, n, spec)
    d, lists = index.centres.shape[1] - 1, len(index.centres)
    cuts = blocks_of(d, spec)
    columns = [f"y{c}" for c in range(len(cuts) - 1)]
    shared = spark.sparkContext.broadcast(index)
    kind = ", ".join(["id long", "v binary", *(f"{c} binary" for c in columns), "near array<int>"])

    def assign(most: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                if batch.num_rows:
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    at = shared.value
                    y = at.place(x) if most == 1 else at.ask(x)
                    packed = {"v": [r.tobytes() for r in x]} | in_blocks(y, cuts)
                    near = at.nearest(y, most).astype(np.int32)
                    yield pa.record_batch({"id": batch.column("id")} | {k: pa.array(r, pa.binary()) for k, r in packed.items()} | {"near": pa.array(list(near), pa.list_(pa.int32()))})

        return run

    same = Window.partitionBy("h", "v").orderBy("id")
    packed = base.mapInArrow(assign(1), kind).select("id", "v", *columns, F.col("near")[0].alias("list"), F.xxhash64("v").alias("h"))
    stored = saved(packed.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= spec.k + 1).select("id", "v", *columns, "list"))
    sizes = saved(stored.groupBy("list").agg(F.count(F.lit(1)).alias("n")))
    asked = saved(base.where(is_query).mapInArrow(assign(index.probes), kind))
    none = F.lit(float("-inf"))
    near = saved(best(scan_lists(stored, asked.select("id", "v", *columns, F.col("near")[0].alias("list"), none.alias("floor")), sizes, index, d, spec, read), spec.k))
    floors = near.where(F.col("rank") == spec.k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = asked.join(floors, "id", "left").select("id", "v", *columns, F.explode(F.slice("near", 2, lists)).alias("list"), F.coalesce("floor", none).alias("floor"))
    more = scan_lists(stored, rest, sizes, index, d, spec, read)
    every = near.select("query_id", "vec_id", "score").unionByName(more).dropDuplicates(["query_id", "vec_id"])
    return best(every, spec.k).select("query_id", "rank", "vec_id", "score")
