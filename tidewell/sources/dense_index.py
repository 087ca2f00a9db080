"""The stored dense index: navigable neighbour graphs over parts of a collection's vectors.

Vectors are dealt to parts of about ``part`` rows by a hash of their key. A part's graph joins each vector
to near ones in different directions (of two candidates that are nearer to each other than to it, only
the nearer stays) and back, with a few random links between far ones. A part is one row: keys,
unit vectors and links, packed. Building deals the rows once; searching moves no vector: every query
walks every part's graph, best vectors first, with a queue of bounded length, and the parts' lists are merged.

Similarity is the cosine; a zero vector has 0 with any other. Rows without a key or a vector are
not indexed, of rows that repeat a key one is; vectors of another length than most are left out.
An index is complete when its last part, ``done``, is there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import QUERY_BLOCK, ranked

STORED = "part int, n int, d int, pks binary, vectors binary, links binary"


@dataclass(frozen=True)
class GraphSpec:
    #: Vectors in a part, about, and the most that a build compares at a time with all others of it.
    part: int = 4096
    #: Links that a vector looks for; with those back to it, it has twice as many at most.
    links: int = 16
    #: Candidates of which these are chosen, and random links of each vector besides.
    candidates: int = 64
    random: int = 2
    #: Vectors that a search keeps in its queue, and those that it starts from.
    queue: int = 64
    starts: int = 8
    seed: int = 7


def graph(v: np.ndarray, spec: GraphSpec) -> np.ndarray:
    """The links of unit vectors, -1 where a vector has fewer."""
    n, rng = len(v), np.random.default_rng(spec.seed)
    chosen: list[list[int]] = []
    for at in range(0, n, 512):
        near = v[at : at + 512] @ v.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        most = min(spec.candidates, n - 1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :most]
        for i, own in enumerate(order):
            between = v[own] @ v[own].T
            keep: list[int] = []
            for j in range(most):
                # a candidate that a chosen one is nearer to is reached through that
                if len(keep) < spec.links and (between[j, keep] <= near[i, own[j]]).all():
                    keep.append(j)
            chosen.append([int(own[j]) for j in keep])
    width = 2 * spec.links + spec.random
    out = np.full((n, width), -1, dtype=np.int32)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(chosen):
        for j in own:
            back[j].append(i)
    for i, own in enumerate(chosen):
        more = [j for j in back[i] if j not in own]
        if len(more) > 2 * spec.links - len(own):
            more = [more[j] for j in np.argsort(-(v[more] @ v[i]), kind="stable")[: 2 * spec.links - len(own)]]
        row = own + more + ([int(x) for x in rng.integers(0, n, spec.random)] if n > 1 else [])
        out[i, : len(row)] = row
    return out


def walk(v: np.ndarray, links: np.ndarray, q: np.ndarray, k: int, spec: GraphSpec) -> tuple[list[tuple[float, int]], int]:
    """(the best k found as (score, number), scores computed): best first, until the queue holds nothing better."""
    n, keep = len(v), max(k, spec.queue)
    start = np.unique(np.linspace(0, n - 1, min(n, spec.starts)).astype(np.int64))
    seen = np.zeros(n, dtype=bool)
    seen[start] = True
    score = v[start] @ q
    read = len(start)
    ahead = [(-s, i) for s, i in zip(score.tolist(), start.tolist(), strict=True)]
    heapq.heapify(ahead)
    best = [(s, -i) for s, i in zip(score.tolist(), start.tolist(), strict=True)]
    heapq.heapify(best)
    while ahead:
        s, i = heapq.heappop(ahead)
        if len(best) >= keep and -s < best[0][0]:
            break
        new = links[i]
        new = np.unique(new[new >= 0])
        new = new[~seen[new]]
        seen[new] = True
        read += len(new)
        for x, j in zip((v[new] @ q).tolist(), new.tolist(), strict=True):
            if len(best) < keep or x > best[0][0]:
                heapq.heappush(ahead, (-x, j))
                heapq.heappush(best, (x, -j))
                if len(best) > keep:
                    heapq.heappop(best)
    return [(s, -i) for s, i in sorted(best, key=lambda b: (-b[0], -b[1]))[:k]], read


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def build(vectors: DataFrame, path: str, vector: str = "v", spec: GraphSpec = GraphSpec()) -> None:
    """Writes the index of (pk long, vector) to a path, over one that is there."""
    rows = vectors.select("pk", F.col(vector).cast("array<double>").alias("v")).where(F.col("pk").isNotNull() & F.col("v").isNotNull())
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (size["d"] if size else 0)).groupBy("pk").agg(F.min("v").alias("v"))
    parts = max(1, -(-(size["count"] if size else 0) // spec.part))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pk")
        v = _unit(np.array(group["v"].tolist(), dtype=np.float64))
        row = {"part": int(group["part"].iloc[0]), "n": len(v), "d": v.shape[1], "pks": group["pk"].to_numpy(np.int64).tobytes(), "vectors": v.tobytes(), "links": graph(v, spec).tobytes()}
        return pd.DataFrame([row])

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("pk"), F.lit(parts)).cast("int"))
    dealt.groupBy("part").applyInPandas(pack, STORED).write.mode("overwrite").parquet(f"{path.rstrip('/')}/parts")
    vectors.sparkSession.range(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/done")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/done/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def top(queries: DataFrame, path: str, limit: int, spec: GraphSpec = GraphSpec(), read: Accumulator | None = None) -> DataFrame:
    """(query_id, pk, score, rank) of the best rows found of queries (query_id long, q), taken in blocks.

    read: counts the scores that walks compute.
    """
    spark = queries.sparkSession
    stored = spark.read.schema(STORED).parquet(f"{path.rstrip('/')}/parts")
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where(F.col("query_id").isNotNull() & F.col("q").isNotNull())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def one(block: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()  # a block is bounded
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(np.int64), rows["q"].tolist()))

        def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            for batch in it:
                for part in batch.to_pylist():
                    n, d = part["n"], part["d"]
                    v = np.frombuffer(part["vectors"], dtype=np.float64).reshape(n, d)
                    links, pks = np.frombuffer(part["links"], dtype=np.int32).reshape(n, -1), np.frombuffer(part["pks"], dtype=np.int64)
                    out: list[tuple] = []
                    for query, q in zip(ids.tolist(), vectors, strict=True):
                        if len(q) == d:
                            found, n_read = walk(v, links, _unit(np.array([q], dtype=np.float64))[0], limit, spec)
                            out += [(query, int(pks[i]), s) for s, i in found]
                            if read is not None:
                                read.add(n_read)
                    yield pa.record_batch({"query_id": pa.array([o[0] for o in out], pa.int64()), "pk": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

        return stored.mapInArrow(search, "query_id long, pk long, score double")

    return ranked(reduce(DataFrame.unionByName, [one(i) for i in range(blocks)]), limit)
