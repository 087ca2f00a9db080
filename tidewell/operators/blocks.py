"""The best rows of batches of queries, by blocks of queries and blocks of rows.

Every block of queries meets every block of rows in one group. Its task works out all scores of the two
blocks in arrays and gives each query's best: of Q queries and N rows, limit * Q rows a block of rows leave
the tasks in place of Q * N pairs, and a task holds two blocks whatever the tables' sizes.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and rows in a block; least rows in a block where there are few.
QUERIES, ROWS, FEW = 1 << 14, 1 << 15, 1 << 10
#: Terms of the queries in a block of a search by terms, and its queries, whose terms are few: about the bytes of a block of rows.
TERMS, TERM_QUERIES = 1 << 22, 1 << 18
#: Queries and rows whose scores are held at once.
HELD_QUERIES, HELD_ROWS = 512, 2048
#: A term is added as a whole array of its block from this share of the block's rows on.
DENSE = 32


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores in billionths, halves away from zero as in SQL's round(score, 9)."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.abs(score) * 1e9
        out = np.where(x < 2.0**52, np.floor(x + 0.5), x)
        close = np.flatnonzero((np.abs(x - np.floor(x) - 0.5) < 1e-5 + x * 1e-15) & (x < 2.0**52))
    for i in close:
        out[i] = float(Decimal(repr(float(abs(score[i])))).quantize(Decimal("1e-9"), rounding=ROUND_HALF_UP) * 10**9)
    return np.copysign(out, score)


def first_of_each(query: np.ndarray, key: np.ndarray, row: np.ndarray, limit: int) -> np.ndarray:
    """Places of the ``limit`` entries of every query with the greatest keys (NaN above all), then the smallest rows."""
    order = np.lexsort((row, -np.nan_to_num(key, nan=np.inf, posinf=np.inf, neginf=-np.inf), ~np.isnan(key), query))
    own = query[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
    return order[np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(own)]]))) < limit]


def products(q: np.ndarray, qi: np.ndarray, v: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed from the first component on."""
    out = np.zeros(len(qi))
    for d in range(q.shape[1]):
        out += q[qi, d] * v[vi, d]
    return out


def nearest(q: np.ndarray, v: np.ndarray, limit: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of every query's best rows.

    A matrix product tells which pairs can be among them; the scores of these are then summed in order.
    """
    rows = lambda m: np.sqrt(products(m, np.arange(len(m)), m, np.arange(len(m))))
    with np.errstate(all="ignore"):
        qn, vn = rows(q), rows(v)
        safe = lambda m, n: np.where(n[:, None] == 0, 0.0, m / n[:, None])
        qs, vs = (safe(q, qn), safe(v, vn)) if cosine else (q, v)
        spare = 4e-9 if cosine else 4e-9 + 1e-12 * float(np.nan_to_num(qn, nan=0.0, posinf=0.0).max(initial=0.0)) * float(np.nan_to_num(vn, nan=0.0, posinf=0.0).max(initial=0.0))
        found = []
        for a in range(0, len(q), HELD_QUERIES):
            block = qs[a : a + HELD_QUERIES]
            floor = np.full(len(block), -np.inf)
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for b in range(0, len(v), HELD_ROWS):
                near = block @ vs[b : b + HELD_ROWS].T
                hit = ~(near < (floor - spare)[:, None])
                if near.shape[1] > limit and hit.sum() > 2 * limit * len(block):
                    low = np.fmax(floor, np.partition(near, -limit, axis=1)[:, -limit])
                    hit = ~(near < (low - spare)[:, None])
                qi, vi = np.nonzero(hit)
                if not len(qi):
                    continue
                score = products(q, qi + a, v, vi + b)
                if cosine:
                    length = vn[vi + b] * qn[qi + a]
                    score = np.where((vn[vi + b] == 0) | (qn[qi + a] == 0), 0.0, score / length)
                best = tuple(np.concatenate(x) for x in zip(best, (qi, vi + b, score), strict=True))
                keep = first_of_each(best[0], rounded(best[2]), best[1], limit)
                best = tuple(x[keep] for x in best)
                n = np.bincount(best[0], minlength=len(block))
                last = np.cumsum(n)[n == limit] - 1  # keep is in order of query and key
                floor[n == limit] = np.where(np.isnan(best[2][last]), np.inf, best[2][last])
            found.append((best[0] + a, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _kinds(vectors: pa.ChunkedArray) -> list[tuple[int | None, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length; length None: those that are null or hold nulls."""
    flat = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(flat), -1).to_numpy(zero_copy_only=False)
    if flat.flatten().null_count:
        parents, empty = pc.list_parent_indices(flat).to_numpy(), flat.flatten().is_null().to_numpy(zero_copy_only=False)
        size = size.copy()
        size[np.unique(parents[empty])] = -1
    out = []
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        if length < 0:
            out.append((None, at, np.zeros((len(at), 0))))
        else:
            out.append((int(length), at, flat.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)))
    return out


def vector_block(queries: pa.Table, rows: pa.Table, limit: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Best rows of a block by vectors. As in the columns of ``functions.vectors``, a pair with a null
    component or of two lengths has no product; its cosine is null where both have a length above zero, else 0."""
    query, row, score = [], [], []

    def told(qi: np.ndarray, vi: np.ndarray, value: float | None) -> None:
        vi = vi[:limit]
        query.append(np.repeat(qi, len(vi)))
        row.append(np.tile(vi, len(qi)))
        score.append(pa.array([value], pa.float64()).take(pa.array(np.zeros(len(qi) * len(vi), np.int64))))

    for ql, qat, q in _kinds(queries["q"]):
        for vl, vat, v in _kinds(rows["_v"]):
            if ql is None or vl is None:
                told(qat, vat, 0.0 if cosine else None)
            elif ql != vl:
                with np.errstate(all="ignore"):
                    qz, vz = ((m * m).sum(1) == 0 if cosine else np.zeros(len(m), bool) for m in (q, v))
                told(qat[~qz], vat[~vz], None)
                told(qat[~qz], vat[vz], 0.0)
                told(qat[qz], vat, 0.0)
            else:
                qi, vi, s = nearest(q, v, limit, cosine)
                query.append(qat[qi])
                row.append(vat[vi])
                score.append(pa.array(s, pa.float64()))
    return np.concatenate(query), np.concatenate(row), pa.concat_arrays(score)


def term_block(queries: pa.Table, rows: pa.Table, limit: int, weigh: Callable | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Best rows of a block by terms; without ``weigh`` by the number of common terms."""
    asked, held = queries["terms"].combine_chunks(), rows["terms"].combine_chunks()
    names = asked.flatten().unique()
    term = pc.index_in(asked.flatten(), names).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ids = pc.fill_null(pc.index_in(held.flatten(), names), -1).to_numpy(zero_copy_only=False)
    doc = pc.list_parent_indices(held).to_numpy()
    at = np.flatnonzero(ids >= 0)
    at = at[np.argsort(ids[at], kind="stable")]
    cut = np.searchsorted(ids[at], np.arange(len(names) + 1))
    doc, n = doc[at], rows.num_rows
    if weigh is None:
        kind = np.uint8 if np.diff(ends).max(initial=0) < 256 else np.uint32
        worth, weight = np.ones(len(at), kind), None
    else:
        kind, weight = np.float64, queries["ws"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        idf = np.zeros(len(names))
        idf[term] = queries["idfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        worth = weigh(idf[ids[at]], rows["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[at], rows["dl"].to_numpy()[doc])
    whole: dict[int, np.ndarray] = {}
    query, row, score = [], [], []
    for k in range(queries.num_rows):
        sums = np.zeros(n, kind)
        for i in range(ends[k], ends[k + 1]):
            t = int(term[i])
            a, b = cut[t], cut[t + 1]
            if (b - a) * DENSE < n:
                sums[doc[a:b]] += worth[a:b] if weight is None else weight[i] * worth[a:b]
                continue
            if t not in whole:
                whole[t] = np.zeros(n, kind)
                whole[t][doc[a:b]] = worth[a:b]
            sums += whole[t] if weight is None else weight[i] * whole[t]
        if weight is None:
            best, level = [], int(sums.max(initial=0))
            while level > 0 and sum(map(len, best)) < limit:
                best.append(np.flatnonzero(sums == level)[: limit - sum(map(len, best))])
                level -= 1
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
        else:
            best = np.flatnonzero(sums > 0)
            if len(best) > limit:
                best = best[sums[best] >= np.partition(sums[best], -limit)[-limit] - 4e-9]
                best = best[first_of_each(np.zeros(len(best), np.int64), rounded(sums[best]), best, limit)]
        query.append(np.full(len(best), k))
        row.append(best)
        score.append(sums[best].astype(np.float64))
    return (*(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (query, row)), pa.array(np.concatenate(score) if score else np.zeros(0)))


def bm25_weight(idf: np.ndarray, tf: np.ndarray, dl: np.ndarray, avgdl: float, k1: float, b: float) -> np.ndarray:
    """Weights of postings, as ``vocabulary.weighed`` gives them."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1.0)))


def query_blocks(queries: DataFrame, in_queries: int | None = None, terms: str | None = None) -> int:
    """How many blocks the queries make."""
    if in_queries or not terms:
        return max(1, -(-queries.count() // (in_queries or QUERIES)))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(terms)), F.lit(0)).alias("t")).first()
    return max(1, -(-size["n"] // TERM_QUERIES), -(-size["t"] // TERMS))


def best(queries: DataFrame, rows: DataFrame, score: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, pa.Array]], in_queries: int | None = None, in_rows: int | None = None, terms: str | None = None) -> DataFrame:
    """(query_id, pk, score): what ``score`` gives of every block of ``queries`` (query_id, ...) and every
    block of ``rows`` (pk, ...), by the places of query and row in them; rows of a block are sorted by pk.

    terms: the column of the queries' terms. Blocks of queries are then cut by the number of terms: every row
    is sent to every block of queries, so blocks of few bytes would send the rows more often than they need be.
    """
    in_rows = in_rows or ROWS
    n, parallel = rows.count(), queries.sparkSession.sparkContext.defaultParallelism
    of_queries = query_blocks(queries, in_queries, terms)
    of_rows = max(1, -(-n // in_rows), min(parallel, -(-n // FEW)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    tasks = max(1, min(4096, 3 * of_queries * of_rows if of_queries * of_rows > 1 else 1))
    asked = queries.withColumn("_a", block("query_id", of_queries)).withColumn("_b", every(of_rows)).repartition(tasks, "_a", "_b")
    held = rows.withColumn("_b", block("pk", of_rows)).withColumn("_a", every(of_queries)).repartition(tasks, "_a", "_b")
    kinds = {f.name: f.dataType.simpleString() for df in (queries, rows) for f in df.schema.fields}
    schema = f"query_id {kinds['query_id']}, pk {kinds['pk']}, score double"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left["query_id"].slice(0, 0), "pk": right["pk"].slice(0, 0), "score": pa.array([], pa.float64())})
        right = right.take(pc.sort_indices(right, sort_keys=[("pk", "ascending")], null_placement="at_start"))
        q, r, s = score(left, right)
        return pa.table({"query_id": left["query_id"].take(pa.array(q)), "pk": right["pk"].take(pa.array(r)), "score": s})

    return asked.groupBy("_a", "_b").cogroup(held.groupBy("_a", "_b")).applyInArrow(meet, schema)
