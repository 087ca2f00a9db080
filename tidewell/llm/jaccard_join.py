"""N-gram Jaccard join: token-combination prefixes, then exact verification.

A document's tokens are its distinct shingles of five words. Equal texts are joined first and one
document of each stands for all. Shingles in at least ``heavy`` of these form the frequent class.
All shingles are ordered with the rare class first. Rare ones are ordered by the level of their cell
and then by hash: cells divide the hashes evenly, and a cell's level is floor(log2) of the number of
documents of its most frequent shingle. A document of n shingles can miss e = floor((1 - t) n) of
them in a partner:

* rare shingles are indexed one by one: the first e + 1 of them, or all if there are fewer. Those of
  level 0 are in one document only and are not sent;
* a document with fewer than e + 1 rare ones also indexes its frequent ones. Whatever partner has no
  rare shingle in common misses all r rare ones, so at most e - r of the frequent ones; extended by
  g = c + 1, the frequent prefix of e - r + g holds the first g common ones. The frequent class is
  cut into c subclasses by hash, one of which has two of the g: every pair of prefix shingles of one
  subclass is indexed. c follows the size level floor(log2 n), and a document writes the pairs of
  each level that a partner's size allows. Below eight shingles frequent ones are indexed one by one.

Documents that share an index entry are candidates. To find components it is enough to compare all
documents of an entry with its most shared document first, and then only those that are still in
different components: by pairs where an entry has few documents, by blocks of documents where it has
many. Every comparison is of the whole sets, so no link between components is lost. Sets are of 64-bit
hashes of shingles: two shingles of one hash would count as one, which among 10^10 documents is to be
expected for a few shingles and moves a similarity by one part in their number.

Buckets of shingles, and what a task packs for them, grow with the number of shingles, so that a group
holds half a million up to 5 * 10^11 shingles in all and grows slowly beyond. Index entries with more
than a thousandth of all entries' rows are joined by broadcast, so that no entry's documents meet in
one task.

Null and empty texts and texts without words have no shingles and are linked with nothing; texts of
fewer than five words are one shingle; long texts are used whole. Rows that repeat an id and a text
are one document; where an id has several texts, any of them links it and its n_shingles is the
largest. Rows with a null id are compared with nothing: n_shingles 0, component_id null.
Empty tables give empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, fetched, join_by_size, mix64, saved, text_of, words_of
from .components import components
from .exact_dedup import _keyed, duplicate_table


@dataclass(frozen=True)
class JoinSpec:
    words: int = 5
    #: Links need 100 * intersection >= percent * union.
    percent: int = 80
    #: Documents from which a shingle is of the frequent class; doubled while more than ``most_heavy``
    #: shingles reach it, which bounds what is broadcast.
    heavy: int = 64
    most_heavy: int = 1 << 22
    #: Cells of four bits that order the rare class: one for eight words, up to two to this power.
    most_cells: int = 26
    #: Ids up to which a filter on documents is broadcast.
    most_ids: int = 1 << 20


def shingles(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = hashes.of(words)
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return _distinct(mix64(h))


def _distinct(h: np.ndarray) -> np.ndarray:
    """The values in order, each once; there is one at least."""
    s = np.sort(h)
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def shingles_of_all(texts: list[list[bytes]], hashes: WordHashes, k: int) -> list[np.ndarray]:
    """What ``shingles`` gives for each text: words of all are hashed at once, and windows within a text are kept."""
    ends = np.cumsum([len(x) for x in texts]).tolist()
    if not ends or ends[-1] < k:
        return [shingles(x, hashes, k) for x in texts]
    w = hashes.of(list(itertools.chain.from_iterable(texts)))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = mix64(h)
    return [_distinct(h[b - len(x) : b - k + 1]) if len(x) >= k else shingles(x, hashes, k) for x, b in zip(texts, ends, strict=True)]


#: Words of texts that are hashed at once; more only of one text.
BLOCK_WORDS = 1 << 15


def sets_of_texts(texts: pa.Array, hashes: WordHashes, k: int) -> Iterator[np.ndarray]:
    """The shingles of each text, those of some texts at once."""
    block: list[list[bytes]] = []
    n = 0
    for text in texts:
        words = words_of(text.as_py())
        if block and n + len(words) > BLOCK_WORDS:
            yield from shingles_of_all(block, hashes, k)
            block, n = [], 0
        block.append(words)
        n += len(words)
    yield from shingles_of_all(block, hashes, k)


def misses(n: int, percent: int) -> int:
    """Shingles of n that a linked partner can lack."""
    return n - (n * percent + 99) // 100


def levels(n: int, percent: int) -> range:
    """Size levels that a partner of a set of n shingles can have."""
    return range(((n * percent + 99) // 100).bit_length() - 1, (n * 100 // percent).bit_length())


def frequent_entries(heavy: np.ndarray, n: int, rare: int, percent: int) -> np.ndarray:
    """Index entries of a document's frequent shingles (sorted by hash)."""
    out, spare = [], misses(n, percent) - rare
    for level in levels(n, percent):
        tag = np.uint64((level + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        if level < 3:
            out.append(mix64(heavy[: spare + 1] ^ tag))
            continue
        classes = max(2, (1 << level) // 16)
        prefix = heavy[: spare + classes + 1]
        own = mix64(prefix) % np.uint64(classes)
        order = np.argsort(own, kind="stable")
        prefix, own = prefix[order], own[order]
        step = 1
        while step < len(prefix):
            same = own[step:] == own[:-step]
            if not same.any():
                break
            out.append(mix64(mix64(prefix[:-step][same] ^ tag) + prefix[step:][same]))
            step += 1
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _sets(batch: pa.RecordBatch, hashes: WordHashes, k: int) -> Iterator[tuple[int, np.ndarray]]:
    yield from zip(batch.column("_id").to_pylist(), sets_of_texts(batch.column("_text"), hashes, k), strict=True)


def chunk_of(bucket_bits: int) -> int:
    """Shingles that a task packs together: a million, and 16 a bucket where there are many buckets."""
    return max(1_000_000, 16 << bucket_bits)



def histogram(s: np.ndarray) -> bytes:
    """Counts of hashes by their low bits, one byte each, about four in a bin; empty where one does not fit."""
    bins = 1 << max(7, (len(s) // 4).bit_length())
    n = np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def most_common(p: bytes, q: bytes, m: int, n: int) -> int:
    """How many of m and n shingles can be the same, by their histograms."""
    if not p or not q:
        return min(m, n)
    x, y = np.frombuffer(p, np.uint8).astype(np.int32), np.frombuffer(q, np.uint8).astype(np.int32)
    while len(x) > len(y):
        x = x.reshape(2, -1).sum(0)
    while len(y) > len(x):
        y = y.reshape(2, -1).sum(0)
    return int(np.minimum(x, y).sum())


def level_of(n: np.ndarray) -> np.ndarray:
    """floor(log2) of positive numbers, 15 at most."""
    return np.minimum(np.frexp(n.astype(np.float64))[1] - 1, 15).astype(np.uint8)


def measured(docs: DataFrame, spec: JoinSpec, bucket_bits: int, cell_bits: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(sorted keys of the frequent class, levels of cells in four bits each, (doc, n, bins) of every document with words).

    A key is the top ``bucket_bits + 32`` bits of a hash that as many documents have as the frequent
    class needs; a cell is its top ``cell_bits``. A task sends four bytes for each distinct shingle of
    a chunk of its documents, by bucket, and the documents' sizes and histograms along with them.
    """
    low, spread, chunk = np.uint64(32 - bucket_bits), 1 << 9, chunk_of(bucket_bits)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, sizes, waiting = WordHashes(), [], [], 0

        def out():
            keys, n = np.unique(np.concatenate(parts) >> low, return_counts=True)
            cut = np.searchsorted(keys, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(32))
            print_, once = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), n == 1
            rows = [(b, p[o].tobytes(), p[~o].tobytes(), c[~o].astype(np.int32).tobytes()) for b, (p, o, c) in enumerate(zip(np.split(print_, cut), np.split(once, cut), np.split(n, cut), strict=True)) if len(p)] + sizes
            return pa.record_batch({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate((("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("n", pa.binary())))})

        for batch in it:
            for doc, s in _sets(batch, hashes, spec.words):
                if not len(s):
                    continue
                parts.append(s)
                sizes.append((-1 - doc % spread, np.array([doc], dtype=np.int64).tobytes(), histogram(s), np.array([len(s)], dtype=np.int32).tobytes()))
                waiting += len(s)
                if waiting >= chunk:
                    yield out()
                    parts, sizes, waiting = [], [], 0
        if waiting:
            yield out()

    inside = cell_bits - bucket_bits

    def find(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        if bucket < 0:
            doc, n = (np.frombuffer(b"".join(group[c]), dtype=kind) for c, kind in (("once", np.int64), ("n", np.int32)))
            return pd.DataFrame({"bucket": bucket, "keys": None, "rows": None, "cells": None, "doc": doc, "n": n, "bins": group["more"].to_numpy()})
        once = [np.frombuffer(x, dtype=np.uint32) for x in group["once"]]
        more = [np.frombuffer(x, dtype=np.uint32) for x in group["more"]]
        n = [np.frombuffer(x, dtype=np.int32) for x in group["n"]]
        prints = np.concatenate(once + more)
        weights = np.concatenate([np.ones(sum(map(len, once)), dtype=np.int64), *n])
        order = np.argsort(prints, kind="stable")
        prints, weights = prints[order], weights[order]
        starts = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
        prints, rows = prints[starts], np.add.reduceat(weights, starts)
        shared, cells = rows > 1, np.zeros(1 << inside, dtype=np.uint8)
        np.maximum.at(cells, prints[shared] >> np.uint32(32 - inside), level_of(rows[shared]))
        often = rows >= spec.heavy
        keys = (np.uint64(bucket) << np.uint64(32)) | prints[often].astype(np.uint64)
        return pd.DataFrame({"bucket": [bucket], "keys": [keys.tobytes()], "rows": [rows[often].astype(np.int64).tobytes()], "cells": [(cells[::2] | cells[1::2] << 4).tobytes()], "doc": pd.array([None], dtype="Int64"), "n": pd.array([None], dtype="Int32"), "bins": [None]})

    found = saved(docs.mapInArrow(count, "bucket int, once binary, more binary, n binary").groupBy("bucket").applyInPandas(find, "bucket int, keys binary, rows binary, cells binary, doc long, n int, bins binary"))
    heavy = frequent_class(found.where(F.length("keys") > 0).select("keys", "rows"), spec)
    cells = np.zeros((1 << bucket_bits, 1 << (inside - 1)), dtype=np.uint8)
    for r in fetched(found.where(F.col("cells").isNotNull()).select("bucket", "cells")):
        cells[r["bucket"]] = np.frombuffer(r["cells"], dtype=np.uint8)
    return heavy, cells.reshape(-1), found.where(F.col("doc").isNotNull()).select("doc", "n", "bins")


def frequent_class(found: DataFrame, spec: JoinSpec) -> np.ndarray:
    """Sorted keys with ``heavy`` documents or more; that number is doubled while there are more than ``most_heavy`` keys.

    The keys are counted where they are, and only those of the class are sent to the driver.
    """
    steps = range(40)

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(steps), dtype=np.int64)
        for batch in it:
            for x in batch.column("rows"):
                rows = np.frombuffer(x.as_py(), dtype=np.int64)
                n += [int((rows >= spec.heavy << i).sum()) for i in steps]
        yield pa.record_batch({"i": pa.array(list(steps), pa.int32()), "k": pa.array(n)})

    counted = {r["i"]: r["k"] for r in found.select("rows").mapInArrow(over, "i int, k long").groupBy("i").agg(F.sum("k").alias("k")).collect()}
    least = spec.heavy << next(i for i in steps if counted.get(i, 0) <= spec.most_heavy)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            pairs = zip(batch.column("keys"), batch.column("rows"), strict=True)
            yield pa.record_batch({"keys": pa.array([np.frombuffer(k.as_py(), dtype=np.uint64)[np.frombuffer(n.as_py(), dtype=np.int64) >= least].tobytes() for k, n in pairs], pa.binary())})

    parts = [np.frombuffer(r["keys"], dtype=np.uint64) for r in fetched(found.mapInArrow(cut, "keys binary"))]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


class HeavyTest:
    """Which hashes belong to heavy keys."""

    def __init__(self, keys: np.ndarray, bucket_bits: int):
        self.keys, self.low = keys, np.uint64(32 - bucket_bits)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[keys & np.uint64((1 << 22) - 1)] = True

    def __call__(self, s: np.ndarray) -> np.ndarray:
        key = s >> self.low
        out = self.maybe[key & np.uint64((1 << 22) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
            out[at] = self.keys[place] == key[at]
        return out


class Levels:
    """The levels of hashes, by their cells."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.shift = cells, np.uint64(64 - len(cells).bit_length())

    def __call__(self, s: np.ndarray) -> np.ndarray:
        cell = s >> self.shift
        return self.cells[cell >> np.uint64(1)] >> ((cell & np.uint64(1)) << np.uint64(2)).astype(np.uint8) & 15


def index_entries(docs: DataFrame, spec: JoinSpec, heavy: np.ndarray, cells: np.ndarray, bucket_bits: int) -> DataFrame:
    """(sig, doc, n): index entries that at least two documents may share.

    Rare shingles travel packed by bucket and are matched there; a rare shingle has fewer documents
    than the frequent class needs, so no group is large. Frequent shingles of a document travel as
    they are and are combined on arrival, one row an entry.
    """
    shared = docs.sparkSession.sparkContext.broadcast((heavy, cells))
    shift, spread, chunk = np.uint64(64 - bucket_bits), 1 << 9, chunk_of(bucket_bits)

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, test, levels_of = WordHashes(), HeavyTest(shared.value[0], bucket_bits), Levels(shared.value[1])
        parts: list[tuple[int, int, np.ndarray]] = []
        frequent: list[tuple[int, bytes, bytes, bytes]] = []
        waiting = 0

        def out():
            keys = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, dtype=np.uint64)
            size = [len(p[2]) for p in parts]
            ids, ns = np.repeat(np.array([p[0] for p in parts], dtype=np.int64), size), np.repeat(np.array([p[1] for p in parts], dtype=np.int32), size)
            order = np.argsort(keys, kind="stable")
            keys, ids, ns = keys[order], ids[order], ns[order]
            cut = np.searchsorted(keys, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << shift)
            prints = (keys >> np.uint64(32 - bucket_bits)).astype(np.uint32)
            rows = [(b, p.tobytes(), i.tobytes(), n.tobytes()) for b, (p, i, n) in enumerate(zip(np.split(prints, cut), np.split(ids, cut), np.split(ns, cut), strict=True)) if len(p)] + frequent
            return pa.record_batch({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate((("bucket", pa.int32()), ("sig", pa.binary()), ("doc", pa.binary()), ("n", pa.binary())))})

        for batch in it:
            for doc, s in _sets(batch, hashes, spec.words):
                if not len(s):
                    continue
                e, common = misses(len(s), spec.percent), test(s)
                rare = s[~common]
                level = levels_of(rare)
                first = np.argsort(level, kind="stable")[: e + 1]
                sent = rare[first[level[first] > 0]]
                if len(sent):
                    parts.append((doc, len(s), sent))
                    waiting += len(sent)
                if len(rare) <= e:
                    often = s[common]
                    most = e - len(rare) + max(2, (1 << levels(len(s), spec.percent)[-1]) // 16) + 1
                    frequent.append((-1 - doc % spread, often[:most].tobytes(), np.array([doc], dtype=np.int64).tobytes(), np.array([len(s), len(rare)], dtype=np.int32).tobytes()))
                    waiting += most
                if waiting >= chunk:
                    yield out()
                    parts, frequent, waiting = [], [], 0
        if waiting:
            yield out()

    def match(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bucket = int(group["bucket"].iloc[0])
        if bucket < 0:
            for k in range(0, len(group), 64):
                found = []
                for sig, doc, n in zip(*(group[c].iloc[k : k + 64] for c in ("sig", "doc", "n")), strict=True):
                    size, rare = np.frombuffer(n, dtype=np.int32)
                    entries = frequent_entries(np.frombuffer(sig, dtype=np.uint64), int(size), int(rare), spec.percent)
                    found.append(pd.DataFrame({"sig": entries.view(np.int64), "doc": np.frombuffer(doc, dtype=np.int64)[0], "n": size}))
                yield pd.concat(found)
            return
        sig, doc, n = (np.concatenate([np.frombuffer(x, dtype=kind) for x in group[c]]) for c, kind in (("sig", np.uint32), ("doc", np.int64), ("n", np.int32)))
        order = np.argsort(sig, kind="stable")
        sig, doc, n = sig[order], doc[order], n[order]
        equal = sig[1:] == sig[:-1]
        shared_ = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        full = (np.uint64(bucket) << np.uint64(32)) | sig[shared_].astype(np.uint64)
        yield pd.DataFrame({"sig": full.view(np.int64), "doc": doc[shared_], "n": n[shared_]})

    packed = docs.mapInArrow(index, "bucket int, sig binary, doc binary, n binary")
    return packed.groupBy("bucket").applyInPandas(lambda g: pd.concat(list(match(g))), "sig long, doc long, n int")


def possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose histograms allow enough common shingles: no true link is lost."""

    @F.arrow_udf("boolean")
    def may(x: pa.Array, y: pa.Array, m: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for p, q, i, j in zip(x.to_pylist(), y.to_pylist(), m.to_pylist(), n.to_pylist(), strict=True):
            most = most_common(p, q, i, j)
            out.append(100 * most >= percent * (i + j - most))
        return pa.array(out, pa.bool_())

    one = sizes.select(F.col("doc").alias("a"), F.col("bins").alias("_pa"), F.col("n").alias("_na"))
    two = sizes.select(F.col("doc").alias("b"), F.col("bins").alias("_pb"), F.col("n").alias("_nb"))
    return pairs.join(one, "a").join(two, "b").where(may("_pa", "_pb", "_na", "_nb")).select("a", "b")


def _sizes_fit(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


#: Shingles of the documents of a cluster that are compared in one group, of either side.
GROUP = 1 << 17
#: Shingles, and 32 for each document, of the small clusters that are compared in one group.
BIN = 1 << 15
#: Documents from which an index entry is compared by blocks and not by pairs.
CROWD = 64


def _packer(spec: JoinSpec):
    @F.arrow_udf("binary")
    def packed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in parts:
            for k in range(0, len(texts), 256):
                yield pa.array([s.tobytes() for s in sets_of_texts(texts[k : k + 256], hashes, spec.words)], pa.binary())

    return packed


def with_sets(need: DataFrame, docs: DataFrame, spec: JoinSpec) -> tuple[DataFrame, DataFrame]:
    """(``need`` with the sets ``s`` of its column doc, the table of sets): a document's set is made once, however
    many rows ask for it."""
    small = need.count() <= spec.most_ids
    ids = need.select("doc").distinct()
    sets = saved(docs.join(F.broadcast(ids) if small else ids, docs["_id"] == ids["doc"]).select("doc", _packer(spec)("_text").alias("s")))
    return sets.join(F.broadcast(need) if small else need, "doc"), sets


def block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of the documents that ask with all others of another component, one for each component."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["s"]]
    size = np.array([len(x) for x in sets])
    if not size.all():
        group, sets, size = group[size > 0], [x for x in sets if len(x)], size[size > 0]
    doc, comp = group["doc"].to_numpy(), group["comp"].to_numpy()
    found: list[tuple[int, int]] = []
    if len(sets):
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        starts, mark = np.concatenate([[0], np.cumsum(size)[:-1]]), np.zeros(len(names), dtype=np.int32)
        for k in np.flatnonzero(group["ask"].to_numpy()).tolist():
            own = at[starts[k] : starts[k] + size[k]]
            mark[own] = 1
            common = np.add.reduceat(mark[at], starts)
            mark[own] = 0
            hit = np.flatnonzero((comp != comp[k]) & (100 * common >= percent * (size[k] + size - common)))
            found += [(doc[k], doc[hit[i]]) for i in np.unique(comp[hit], return_index=True)[1]]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def crowd_links(crowd: DataFrame, docs: DataFrame, spec: JoinSpec, rows: int) -> DataFrame:
    """Links between components among documents that share crowded entries: crowd (sig, doc, n, comp).

    A cluster is what crowded entries join. Its largest component's documents need no comparison
    with each other, so only the others ask: their blocks meet all blocks, no pair becomes a row, and
    every pair of different components is compared.
    """
    hub = crowd.groupBy("sig").agg(F.min("doc").alias("b"), F.count(F.lit(1)).alias("_rows"))
    clusters = components(join_by_size(crowd, hub, "sig", "_rows", rows).where("doc != b").select(F.col("doc").alias("a"), "b").distinct())
    members = saved(crowd.groupBy("doc").agg(F.max("n").cast("long").alias("n"), F.min("comp").alias("comp")).join(clusters.select(F.col("node").alias("doc"), F.col("comp").alias("cluster")), "doc"))
    parts = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("_k"))
    top = parts.groupBy("cluster").agg(F.max_by("comp", F.struct("_k", "comp")).alias("top"))
    sided = members.join(top, "cluster").withColumn("ask", F.col("comp") != F.col("top"))
    blocks = sided.groupBy("cluster").agg(F.ceil(F.sum(F.when(F.col("ask"), F.col("n"))) / GROUP).alias("_u"), F.ceil(F.sum(F.when(~F.col("ask"), F.col("n"))) / GROUP).alias("_t")).where("_u > 0")
    placed = sided.join(blocks, "cluster").withColumn("i", F.pmod(F.xxhash64("doc"), F.when(F.col("ask"), F.col("_u")).otherwise(F.col("_t"))))
    others = F.explode(F.sequence(F.lit(0), F.col("_u") - 1)).alias("o")
    asks = placed.where("ask").select("cluster", "doc", "comp", "ask", "i", "_t", others).select("cluster", "doc", "comp", "ask", F.least("i", "o").alias("x"), (-1 - F.greatest("i", "o")).alias("y"))
    meets = placed.where("ask").select("cluster", "doc", "comp", "ask", F.col("i").alias("x"), F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("y"))
    told = placed.where("not ask").select("cluster", "doc", "comp", "ask", others, "i").select("cluster", "doc", "comp", "ask", F.col("o").alias("x"), F.col("i").alias("y"))
    need = saved(asks.unionByName(meets).unionByName(told))
    asked, sets = with_sets(need, docs, spec)
    percent = spec.percent
    found = saved(asked.groupBy("cluster", "x", "y").applyInPandas(lambda g: block_links(g, percent), "a long, b long"))
    discard(members, need, sets)
    return found


def compared(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, spec: JoinSpec) -> DataFrame:
    """The links among the candidate pairs (a, b).

    Pairs are compared by cluster, the components of the candidate graph, so that a document's set
    travels once and not with each of its pairs. A large cluster is cut into blocks of documents; a
    group is a pair of blocks and gets only the documents that its pairs name. Clusters of one block
    share groups, as most have a few documents only.
    """
    pairs = saved(possible(pairs, sizes, spec.percent))
    clusters = components(pairs)
    weighed = clusters.join(sizes.groupBy("doc").agg(F.max("n").alias("n")), F.col("node") == F.col("doc")).select("doc", "comp", "n")
    blocks = weighed.groupBy("comp").agg(F.ceil(F.sum("n") / GROUP).alias("_m"))
    placed = saved(weighed.join(blocks, "comp").select("doc", "comp", F.pmod(F.xxhash64("doc"), F.col("_m")).alias("block"), "n", "_m"))
    bins = 1 + int(placed.where("_m = 1").agg(F.sum(F.col("n") + 32)).first()[0] or 0) // BIN
    grouped = placed.withColumn("comp", F.when(F.col("_m") == 1, -1 - F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp")))
    one, two = grouped.select(F.col("doc").alias("a"), "comp", F.col("block").alias("_x")), grouped.select(F.col("doc").alias("b"), F.col("block").alias("_y"))
    key = ["comp", "x", "y"]
    keyed = saved(pairs.join(one, "a").join(two, "b").select("comp", F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"), "a", "b"))
    need = saved(keyed.select(*key, F.col("a").alias("doc")).unionByName(keyed.select(*key, F.col("b").alias("doc"))).distinct())

    def check(sets: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known: dict[int, list[np.ndarray]] = {}
        for doc, s in zip(sets["doc"], sets["s"], strict=True):
            known.setdefault(doc, []).append(np.frombuffer(s, dtype=np.uint64))
        found = []
        for a, b in zip(asked["a"], asked["b"], strict=True):
            for p in known.get(a, ()):
                for q in known.get(b, ()):
                    small, large = (p, q) if len(p) < len(q) else (q, p)
                    if not len(small):
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    common = int((large[at] == small).sum())
                    if 100 * common >= spec.percent * (len(p) + len(q) - common):
                        found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64").drop_duplicates()

    asked, sets = with_sets(need, docs, spec)
    found = saved(asked.groupBy(*key).cogroup(keyed.groupBy(*key)).applyInPandas(check, "a long, b long"))
    discard(pairs, placed, keyed, need, sets)
    return found


def links(docs: DataFrame, spec: JoinSpec) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) that join every component, (doc, n)) of ``docs`` (_id, _text; no two texts equal)."""
    chars = docs.agg(F.sum(F.length("_text"))).first()[0] or 0
    total = max(1, chars // 5)
    bucket_bits = min(20, max(8, (total >> 19).bit_length()))
    cell_bits = min(spec.most_cells, max(21, (total >> 3).bit_length()))
    heavy, cells, sizes = measured(docs, spec, bucket_bits, cell_bits)
    raw = saved(index_entries(docs, spec, heavy, cells, bucket_bits))
    counts = raw.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("_lo"), F.max("doc").alias("_hi")).where("_lo < _hi").select("sig", "m")
    counts = saved(counts)
    rows = int(counts.agg(F.sum("m")).first()[0] or 0)
    by_entry = lambda left, right: join_by_size(left, right, "sig", "_rows", rows)
    counted = saved(by_entry(raw, counts.withColumn("_rows", F.col("m"))))
    discard(raw)
    # the document whose entries are shared most is the likeliest to be like all others
    weight = counted.groupBy("doc").agg(F.avg("m").alias("w"))
    entries = saved(counted.join(weight, "doc"))
    discard(counted)
    centers = entries.groupBy("sig").agg(F.max_by(F.struct("doc", "n"), F.struct("w", "doc")).alias("c"), F.count(F.lit(1)).alias("_rows")).select("sig", F.col("c.doc").alias("c"), F.col("c.n").alias("cn"), "_rows")
    first = by_entry(entries, centers).where((F.col("doc") != F.col("c")) & _sizes_fit("n", "cn", spec.percent)).select(F.least("doc", "c").alias("a"), F.greatest("doc", "c").alias("b")).distinct()
    first = saved(first)
    found = compared(first, docs, sizes, spec)
    labels = components(found)
    labelled = entries.join(labels, entries["doc"] == labels["node"], "left").select("sig", "doc", "n", "m", F.coalesce("comp", "doc").alias("comp"))
    open_ = labelled.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count(F.lit(1)).alias("_rows")).where("_lo < _hi").select("sig", "_rows")
    labelled = saved(by_entry(labelled, open_))
    crowd = labelled.where(F.col("m") >= CROWD)
    few = labelled.where(F.col("m") < CROWD)
    other = few.select("sig", F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bcomp"))
    second = few.join(other, "sig").where((F.col("doc") < F.col("b")) & (F.col("comp") != F.col("bcomp")) & _sizes_fit("n", "bn", spec.percent)).select(F.col("doc").alias("a"), "b").distinct()
    second = second.join(first, ["a", "b"], "left_anti")
    more = compared(second, docs, sizes, spec).unionByName(crowd_links(crowd, docs, spec, rows))
    return found.unionByName(more), sizes.select("doc", "n")


def _without(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """``docs`` without the rows of these ids (_lost); the ids travel whole only up to ``most`` of them."""
    return docs.join(F.broadcast(ids) if ids.count() <= most else ids, docs[docs.columns[0]] == ids["_lost"], "left_anti")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: JoinSpec = JoinSpec()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the distinct ids of documents with words."""
    known = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].cast("long").alias("_id"), text_of(docs, text).alias("_text"))
    wordy = known.where(F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    table = duplicate_table(wordy, "_id", "_text", keep="min").where("group_size > 1")
    copies = saved(table.where(F.col("_tw_id") != F.col("keep_id")).select(F.col("_tw_id").alias("node"), F.col("keep_id").alias("rep"), "_tw_sha").distinct())
    several = saved(known.groupBy("_id").count().where("count > 1").select(F.col("_id").alias("own")))
    if not several.count():
        found, sizes = links(_without(wordy, copies.select(F.col("node").alias("_lost")), spec.most_ids), spec)
        return _labelled(sizes, components(found), copies, doc_id)
    # an id with several texts loses only the copied ones; its copies are links like others
    alone = copies.join(several, copies["node"] == several["own"], "left_anti")
    partly = copies.join(several, copies["node"] == several["own"], "left_semi")
    kept = _without(wordy, alone.select(F.col("node").alias("_lost")), spec.most_ids)
    gone = saved(partly.groupBy("node").agg(F.collect_set("_tw_sha").alias("_gone")))
    small = gone.count() <= spec.most_ids
    kept = _keyed(kept.join(F.broadcast(gone) if small else gone, kept["_id"] == gone["node"], "left"), "_id", "_text")
    found, sizes = links(kept.where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("_tw_sha"))).select("_id", "_text"), spec)
    mixed = saved(partly.unionByName(alone.join(several, alone["rep"] == several["own"], "left_semi")).select("node", "rep").distinct())
    labels = components(found.select("a", "b").unionByName(mixed.select(F.col("rep").alias("a"), F.col("node").alias("b"))))
    ids = saved(mixed.select(F.col("node").alias("_mixed")).distinct())
    every = _labelled(sizes, labels, copies.drop("_tw_sha").distinct(), doc_id).join(ids, F.col(doc_id) == F.col("_mixed"), "left_anti")
    whole = shingle_counts(wordy.join(ids, wordy["_id"] == ids["_mixed"], "left_semi"), spec).groupBy("doc").agg(F.max("n").alias("n")).join(labels, F.col("doc") == labels["node"])
    return every.unionByName(whole.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id")))


def shingle_counts(docs: DataFrame, spec: JoinSpec) -> DataFrame:
    """(doc, n) of every row of ``docs`` (_id, _text) with words."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            rows = [(doc, len(s)) for doc, s in _sets(batch, hashes, spec.words) if len(s)]
            yield pa.record_batch({"doc": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64())})

    return docs.select("_id", "_text").mapInArrow(count, "doc long, n long")


def _labelled(sizes: DataFrame, labels: DataFrame, copies: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of the documents of ``sizes`` and their copies."""
    own = saved(sizes.groupBy("doc").agg(F.max("n").cast("long").alias("n")).join(labels, F.col("doc") == labels["node"], "left").select("doc", "n", F.coalesce("comp", "doc").alias("comp")))
    of_copies = copies.join(own, copies["rep"] == own["doc"]).select("node", "n", "comp")
    every = own.unionByName(of_copies.withColumnRenamed("node", "doc"))
    return every.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: JoinSpec = JoinSpec()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    found = near_duplicates(docs, doc_id, text, spec)
    return docs.select(doc_id).join(found, doc_id, "left").select(doc_id, F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", F.col(doc_id)).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: JoinSpec = JoinSpec()) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; columns as they were."""
    found = near_duplicates(docs, doc_id, text, spec)
    lost = saved(found.where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias("_tw_lost")))
    small = lost.count() <= spec.most_ids
    return docs.join(F.broadcast(lost) if small else lost, docs[doc_id] == F.col("_tw_lost"), "left_anti")
