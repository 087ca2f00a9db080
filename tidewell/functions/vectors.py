"""Vector columns and offline stand-ins for model calls."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length > 0, inner(a, b) / length).otherwise(F.lit(0.0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


#: Tokens of the rows that are embedded at once, more only of one row; tokens whose hashes stay known.
TOKENS, KNOWN = 1 << 18, 1 << 17


def token_slices(rows: pa.Array, most: int) -> Iterator[pa.Array]:
    """A list array in slices of consecutive rows with up to ``most`` items, more only of one row."""
    ends, at = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(rows):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield rows.slice(at, to - at)
        at = to


@cache
def _embedder(dimension: int):
    @F.arrow_udf("array<double>")
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: dict[str | None, int] = {}

        def code(token: str) -> int:
            got = seen.get(token)
            if got is None:
                if len(seen) >= KNOWN:
                    seen.clear()
                got = seen[token] = int(hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()[:4], 16) % (2 * dimension)
            return got

        def embedded(rows: pa.Array) -> pa.Array:
            named = rows.flatten().dictionary_encode()  # a token is looked up once a slice
            codes = np.array([0 if t is None else code(t) for t in named.dictionary.to_pylist()], dtype=np.int64)
            known = named.indices.is_valid().to_numpy(zero_copy_only=False)
            own = codes[named.indices.fill_null(0).to_numpy()[known]] if len(codes) else np.zeros(0, dtype=np.int64)
            row = pc.list_parent_indices(rows).to_numpy()[known]
            made = np.bincount(row * dimension + own // 2, weights=own % 2 * 2.0 - 1.0, minlength=len(rows) * dimension).astype(np.float64).reshape(len(rows), dimension)
            length = np.sqrt((made * made).sum(1, keepdims=True))  # of whole numbers, so exact
            made = np.divide(made, length, out=np.zeros_like(made), where=length > 0)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dimension)
            return pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))

        for rows in parts:
            if len(rows):
                yield pa.concat_arrays([embedded(x) for x in token_slices(rows, TOKENS)])
            else:
                yield embedded(rows)

    return embed


def hash_embedding(tokens: Column, dimension: int = 64) -> Column:
    """A deterministic embedding of a token array: signed counts by hash, scaled to length 1.

    A token's hash is a number whose last bit is the sign and whose others are the slot.
    """
    return _embedder(dimension)(tokens)


def normalised(score: Column, metric: str) -> Column:
    """A score of a metric as a number from 0 to 1, for weighted fusion."""
    if metric == "COSINE":
        return (1 + score) / 2
    if metric == "IP":
        return 0.5 + F.atan(score) / F.lit(3.141592653589793)
    if metric == "BM25":
        return 2 * F.atan(score) / F.lit(3.141592653589793)
    raise ValueError(f"unknown metric {metric}")
