"""Repeated byte strings across documents, from the interval tree of an enhanced suffix array.

The suffix array is sparse. Of every ``length`` bytes in a row one position is sampled by content: the
first of the least hash among the ``gram``-byte strings inside. Equal strings of ``length`` bytes have
equal samples, so two such strings show as two sampled suffixes that share their first bytes (the
gram at least) and the bytes before them. A sample's context is what of that matters: ``length - gram``
bytes before it and ``length`` from it on, cut at the ends of the document.

* A gram that occurs once is in no repeat: only samples of repeated grams go on, and of samples with the
  same context one stands for all, as each of them repeats as far as a context reaches.
* The contexts of a gram are the suffixes of one piece of the array. Spark sorts them; neighbours give the
  common prefixes; a stack scan yields the tree of common-prefix intervals. In each interval the
  members are put in the order of the bytes before them, read backwards, and scanned the same way: an interval
  of both orders, whose members differ in the next byte on either side, is a maximal repeat, with all its
  occurrences.
* A gram with more than ``block`` contexts is cut before the scan. The offsets that a sample can have in
  a repeat are halved; contexts that repeat at an offset of one half share a longer string, by
  which they are grouped anew, and contexts that are equal as far as that half reaches are one again. After
  eight halvings such a group is one string, so every group ends below ``block`` or as one.

Repeats longer than a context are several overlapping ones; ``repeated_spans`` joins them. Hashes of grams
and of contexts have 64 bits each and count together wherever strings are taken as equal.

Rows are documents: a row that repeats another's text is a copy, whatever its id, so a text of at
least ``length`` bytes that several rows have is a repeat as a whole. Null text counts as empty; matches
never cross documents; shorter texts repeat nothing; very long ones are read in pieces. Null
and repeated ids stay as they are, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_by_size, mix64, release, saved, saved_parts, text_of
from .exact_dedup import exact_dedup


@dataclass(frozen=True)
class RepeatSpec:
    #: Bytes of the shortest repeat, and of the strings that are sampled.
    length: int = 200
    gram: int = 64
    #: Contexts that one scan takes together.
    block: int = 4096
    #: Bytes of a long text that are hashed at a time.
    piece: int = 1 << 19

    @property
    def before(self) -> int:
        """Bytes before a sample that a repeat can have."""
        return self.length - self.gram


#: The hash of a string is a sum of its bytes' values times powers of an odd number, modulo 2 ** 64.
_VALUES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Sampler:
    """Samples of texts, with the hashes of their grams and contexts."""

    def __init__(self, spec: RepeatSpec):
        most = spec.piece + 2 * spec.length + spec.before
        self.spec, self.up, self.down = spec, _powers(_BASE, most + 1), _powers(pow(_BASE, -1, 1 << 64), most + 1)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, gram hashes, context hashes) of the samples of a text of ``length`` bytes or more."""
        spec, parts = self.spec, []
        for at in range(0, len(data) - spec.length + 1, spec.piece):
            low = max(0, at - spec.before)
            parts.append(self._piece(data[low : at + spec.piece + spec.before + spec.length], at - low, low, len(data)))
        if len(parts) == 1:
            return parts[0]
        every, g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        every, first = np.unique(every, return_index=True)
        return every, g[first], c[first]

    def _piece(self, data: np.ndarray, skip: int, low: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Samples of the strings that begin at ``skip`` or later, up to a piece's number of them."""
        spec = self.spec
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=sums[1:])

        def hashes(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            return mix64((sums[end] - sums[begin]) * self.down[begin])

        grams = (sums[spec.gram :] - sums[: -spec.gram]) * self.down[: len(data) - spec.gram + 1]
        # the order of grams: the high bits of a product, then the position, so that a minimum is a place
        least = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        least = (least & ~_LOW) | np.arange(len(least), dtype=np.uint64)
        least = least[skip : skip + spec.piece + spec.before]
        width, size = spec.before + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        place = (least & _LOW).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        begin, end = np.maximum(place + low - spec.before, 0), np.minimum(place + low + spec.length, n)
        context = hashes(begin - low, end - low) ^ mix64(((place + low - begin) * 4096 + (end - begin)).astype(np.uint64))
        return (place + low).astype(np.int64), mix64(grams[place]).view(np.int64), context.view(np.int64)


def texts_in(column: pa.Array) -> list[np.ndarray]:
    """The byte strings of a binary column, as views."""
    if not len(column):
        return []
    _, offsets, data = column.buffers()
    bound = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return [every[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def sampled(texts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(key, pos, h, c): the samples of ``texts`` (key, body binary), with hashes of gram and context."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(spec)

        def out(own, keys, found):
            p, g, c = (np.concatenate(x) for x in zip(*found, strict=True))
            row = np.repeat(own, [len(f[0]) for f in found])
            return pa.record_batch({"key": keys.take(pa.array(row)), "pos": pa.array(p), "h": pa.array(g), "c": pa.array(c)})

        for batch in it:
            own, found, n = [], [], 0
            for i, data in enumerate(texts_in(batch.column("body"))):
                if len(data) >= spec.length:
                    own.append(i)
                    found.append(sampler.of(data))
                    n += len(found[-1][0])
                if n > 50_000:
                    yield out(own, batch.column("key"), found)
                    own, found, n = [], [], 0
            if found:
                yield out(own, batch.column("key"), found)

    return texts.mapInArrow(run, "key binary, pos long, h long, c long")


def cut_contexts(texts: DataFrame, wanted: DataFrame, spec: RepeatSpec) -> DataFrame:
    """(h, c, m, left, right) of ``wanted`` (key, pos, h, c, m); ``left`` holds the bytes before, read backwards."""
    places = wanted.groupBy("key").agg(F.collect_list(F.struct("pos", "h", "c", "m")).alias("at"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: dict[str, list] = {"h": [], "c": [], "m": [], "left": [], "right": []}
            ends = batch.column("at").offsets.to_numpy()
            at = batch.column("at").values
            pos, h, c, m = (at.field(f).to_numpy() for f in ("pos", "h", "c", "m"))
            for data, a, b in zip(texts_in(batch.column("body")), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                body = data.tobytes()
                for p in pos[a:b].tolist():
                    out["left"].append(body[max(0, p - spec.before) : p][::-1])
                    out["right"].append(body[p : p + spec.length])
                out["h"].append(h[a:b])
                out["c"].append(c[a:b])
                out["m"].append(m[a:b])
                if len(out["left"]) > 10_000:
                    yield _contexts(out)
                    out = {k: [] for k in out}
            if out["left"]:
                yield _contexts(out)

    return texts.join(places, "key").select("body", "at").mapInArrow(run, "h long, c long, m long, left binary, right binary")


def _contexts(out: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch({k: pa.array(v, pa.binary()) if k in ("left", "right") else pa.array(np.concatenate(v)) for k, v in out.items()})


def _common(strings: list[bytes], order: np.ndarray | None = None) -> np.ndarray:
    """Common prefixes of neighbours: entry i is of strings i and i + 1."""
    lens = np.array([len(s) for s in strings], dtype=np.int64)
    wide = int(lens.max(initial=0)) + 1
    table = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), wide)
    if order is not None:
        lens, table = lens[order], table[order]
    return np.minimum(np.where((differ := table[1:] != table[:-1]).any(1), differ.argmax(1), wide), np.minimum(lens[1:], lens[:-1]))


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (prefix, first, last) of an enhanced suffix array, by a stack scan: those of
    at least ``least`` bytes, inner ones before outer ones."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > value:
            prefix, first = stack.pop()
            yield prefix, first, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal(left: list[bytes], right: list[bytes], common: np.ndarray, spec: RepeatSpec) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes before, bytes from the sample on, members) of the maximal repeats among sorted contexts."""
    backwards = np.array(sorted(range(len(left)), key=left.__getitem__))
    rank = np.empty_like(backwards)
    rank[backwards] = np.arange(len(backwards))
    shared = _common(left, backwards)
    ranks = SparseMinimum(shared)
    for prefix, first, last in intervals(common.tolist(), spec.gram):
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[first : last + 1])]
        near = ranks.between(rank[members[:-1]], rank[members[1:]])
        follows = [right[i][prefix : prefix + 1] for i in members.tolist()]
        for suffix, a, b in intervals(near.tolist(), spec.length - prefix):
            # members that go on alike are a longer repeat, which an inner interval gives
            if any(f != follows[a] for f in follows[a + 1 : b + 1]) or not follows[a]:
                yield suffix, prefix, members[a : b + 1]


class SparseMinimum:
    """Least value between two places of a row, from a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of values[a:b] for each pair a < b."""
        out = np.empty(len(a), dtype=np.int64)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.levels[k][a[of]], self.levels[k][b[of] - (1 << int(k))])
        return out


FOUND = "h long, c long, l int, r int, repeat long"


def scanned(contexts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """FOUND rows, one an occurrence of a maximal repeat, of contexts (g, h, c, left, right), group by group ``g``.

    ``repeat`` numbers the repeats of a group by a hash.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in it:
            rest.append(batch)
            if sum(b.num_rows for b in rest) >= 2 * spec.block:
                table = pa.Table.from_batches(rest).combine_chunks()
                g = table.column("g").to_numpy()
                whole = int(np.searchsorted(g, g[-1]))
                if whole:
                    yield _scan(table.slice(0, whole), spec)
                rest = table.slice(whole).to_batches()
        if rest and sum(b.num_rows for b in rest):
            yield _scan(pa.Table.from_batches(rest).combine_chunks(), spec)

    return contexts.repartition("g").sortWithinPartitions("g", "right", "left").select("g", "h", "c", "left", "right").mapInArrow(run, FOUND)


def _scan(table: pa.Table, spec: RepeatSpec) -> pa.RecordBatch:
    g, h, c = (table.column(x).to_numpy() for x in ("g", "h", "c"))
    left, right = table.column("left").to_pylist(), table.column("right").to_pylist()
    common = np.where(g[1:] == g[:-1], _common(right), -1) if len(g) > 1 else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
    size = np.diff(cuts)
    row, l, r, name = [], [], [], []
    # groups of two are one interval of one pair
    two = cuts[:-1][size == 2]
    if len(two):
        pairs = [left[i] for a in two.tolist() for i in (a, a + 1)]
        shared = _common(pairs)[::2]
        good = shared + common[two] >= spec.length
        for i in (0, 1):
            row.append(two[good] + i)
            l.append(shared[good])
            r.append(common[two][good])
            name.append(h[two][good] ^ mix64(c[two][good].view(np.uint64)).view(np.int64))
    for a, b in zip(cuts[:-1][size > 2].tolist(), cuts[1:][size > 2].tolist(), strict=True):
        for before, after, members in maximal(left[a:b], right[a:b], common[a : b - 1], spec):
            at = members + a
            row.append(at)
            l.append(np.full(len(at), before))
            r.append(np.full(len(at), after))
            first = int(at.min())
            name.append(np.full(len(at), h[first] ^ mix64(c[first : first + 1].view(np.uint64) + np.uint64(before * 4096 + after)).view(np.int64)[0]))
    every = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (row, l, r, name)]
    return pa.record_batch({"h": pa.array(h[every[0]]), "c": pa.array(c[every[0]]), "l": pa.array(every[1].astype(np.int32)), "r": pa.array(every[2].astype(np.int32)), "repeat": pa.array(every[3])})


def cut_down(big: DataFrame, spec: RepeatSpec) -> Iterator[DataFrame]:
    """FOUND rows of contexts (h, c, left, right) whose gram has more than ``block``; see the module's text."""
    here = big.select("h", "c", "left", "right", F.lit(0).alias("lo"), F.lit(spec.before).alias("hi"))
    left, right = F.length("left"), F.length("right")
    while True:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi"))))
        here = here.select("h", "c", "left", "right", halves.alias("d")).select("h", "c", "left", "right", "d.lo", "d.hi")
        here = here.where((F.col("lo") <= F.col("hi")) & (left >= F.col("lo")) & (right >= spec.length - F.col("hi")))

        def named(a, b):
            return F.unhex(F.md5(F.concat(F.encode(F.concat_ws(",", F.col("lo"), F.least(a, left), F.least(b, right), F.lit("")), "UTF-8"), F.substring("left", 1, a), F.substring("right", 1, b))))

        core, hull = named(F.col("lo"), spec.length - F.col("hi")), named(F.col("hi"), spec.length - F.col("lo"))
        here = saved(here.withColumns({"core": core, "hull": hull}))
        if here.isEmpty():
            return
        whole = saved(here.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "c")).alias("at")))
        repeated = whole.where("n > 1").withColumn("repeat", F.xxhash64("core", "hull"))
        reach = [F.least(F.col("hi"), left).cast("int").alias("l"), F.least(spec.length - F.col("lo"), right).cast("int").alias("r")]
        yield join_by_size(here, repeated.select("core", "hull", "n", "repeat"), ["core", "hull"], "n", here.count()).select("h", "c", *reach, "repeat")
        sizes = whole.groupBy("core").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        few, many = sizes.where(F.col("m") <= spec.block), sizes.where(F.col("m") > spec.block)
        one = whole.select("core", "at.h", "at.c")
        yield scanned(here.join(one.join(few, "core").drop("m"), ["core", "h", "c"]).withColumn("g", F.xxhash64("core")), spec)
        # there are fewer of these than a block-th of the rows; where one gram has most, they are few and large
        here = here.join(one.join(many, "core").drop("m"), ["core", "h", "c"]).select("h", "c", "left", "right", "lo", "hi")


def with_bodies(docs: DataFrame, doc_id: str, text: str, spec: RepeatSpec) -> DataFrame:
    """(key, body) of each different text that is long enough to hold a repeat, once."""
    slim = docs.select(F.col(doc_id).alias("_tw_row"), text_of(docs, text).alias("_tw_text")).where(F.octet_length("_tw_text") >= spec.length)
    return exact_dedup(slim, "_tw_row", "_tw_text").select(key_of("_tw_text").alias("key"), F.col("_tw_text").cast("binary").alias("body"))


def key_of(text: str):
    """The first half of the SHA-256 of a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


@dataclass
class Repeats:
    texts: DataFrame
    #: (key, pos, h, c): samples whose gram repeats.
    samples: DataFrame
    #: (h, c, n): contexts and the number of their samples.
    contexts: DataFrame
    #: FOUND rows: contexts that are occurrences of maximal repeats with other contexts.
    found: DataFrame


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: RepeatSpec = RepeatSpec()) -> Repeats:
    texts = saved(with_bodies(docs, doc_id, text, spec), "zstd")
    every = saved(sampled(texts, spec))
    n = every.count()
    again = saved(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    release(docs.sparkSession)
    samples = saved(join_by_size(every, again, "h", "n", n).select("key", "pos", "h", "c"))
    discard(every)
    contexts = saved(samples.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "pos")).alias("at")))
    several = saved(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    release(docs.sparkSession)
    wanted = join_by_size(contexts.select("h", "c", "at.key", "at.pos"), several.withColumn("rows", F.col("m")), "h", "rows", max(1, n // 50))
    cut = saved(cut_contexts(texts, wanted.select("key", "pos", "h", "c", "m"), spec), "zstd")
    release(docs.sparkSession)
    found = saved(scanned(cut.where(F.col("m") <= spec.block).withColumn("g", F.col("h")), spec))
    big = cut.where(F.col("m") > spec.block)
    if not big.isEmpty():
        found = found.unionByName(saved_parts(cut_down(big, spec)))
    discard(cut)
    return Repeats(texts, samples, contexts.select("h", "c", "n"), found)


def repeat_groups(found: Repeats, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """(repeat, key, start, length): every occurrence of every maximal repeat, as far as contexts reach."""
    own = found.contexts.where("n > 1").select("h", "c", "n", F.lit(spec.before).alias("l"), F.lit(spec.length).alias("r"), F.xxhash64("h", "c").alias("repeat"))
    every = own.unionByName(found.found.join(found.contexts, ["h", "c"]).select("h", "c", "n", "l", "r", "repeat"))
    at = found.samples.join(every, ["h", "c"])
    sizes = found.texts.select("key", F.length("body").alias("size"))
    start, end = F.greatest(F.col("pos") - F.col("l"), F.lit(0)), F.least(F.col("pos") + F.col("r"), F.col("size"))
    return at.join(sizes, "key").select("repeat", "key", start.alias("start"), (end - start).alias("length")).distinct()


def repeated_spans(found: Repeats, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """(key, spans array of begin and end): where a text is covered by repeats; spans may overlap and pass the end."""
    # a context that several samples have is covered as far as it reaches; others as far as their repeats do
    own = found.contexts.where("n > 1").select("h", "c", "n", F.lit(spec.before).alias("l"), F.lit(spec.length).alias("r"))
    single = found.contexts.where("n = 1")
    other = found.found.groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r")).join(single, ["h", "c"]).select("h", "c", "n", "l", "r")
    reach = saved(own.unionByName(other))
    release(reach.sparkSession)
    at = join_by_size(found.samples, reach, ["h", "c"], "n", max(1, found.samples.count()))
    return at.groupBy("key").agg(F.collect_list(F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))).alias("spans"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """Of every row: its id, ``_tw_bytes``, ``_tw_removed``, ``_tw_spans`` and ``_tw_kept_sha`` after all repeats are taken out."""
    found = find_repeats(docs, doc_id, text, spec)
    body = text_of(docs, text)
    rows = saved(docs.select(F.col(doc_id).alias("_tw_id"), F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("long").alias("size")).withColumn("key", F.unhex(F.substring("sha", 1, 32))))
    copies = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    alone = copies.where("n = 1").select("key")
    spans = repeated_spans(found, spec).join(alone, "key")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            removed, runs, shas = [], [], []
            ends = batch.column("spans").offsets.to_numpy()
            a, b = (batch.column("spans").values.field(f).to_numpy() for f in ("a", "b"))
            for data, i, j in zip(texts_in(batch.column("body")), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                begin, end = joined(a[i:j], b[i:j], len(data))
                keep, at = hashlib.sha256(), 0
                for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                    keep.update(data[at:x])
                    at = y
                keep.update(data[at:])
                removed.append(int((end - begin).sum()))
                runs.append(len(begin))
                shas.append(keep.hexdigest())
            yield pa.record_batch({"key": batch.column("key"), "removed": pa.array(removed, pa.int64()), "runs": pa.array(runs, pa.int64()), "kept_sha": pa.array(shas, pa.string())})

    done = saved(found.texts.join(spans, "key").select("key", "body", "spans").mapInArrow(cut, "key binary, removed long, runs long, kept_sha string"))
    what = copies.join(done, "key", "left").withColumn("_n", F.col("n"))
    every = join_by_size(rows, what, "key", "_n", max(1, rows.count()))
    whole = (F.col("n") > 1) & (F.col("size") >= spec.length)
    zero = F.lit(0).cast("long")
    return every.select(
        "_tw_id",
        F.col("size").alias("_tw_bytes"),
        F.when(whole, F.col("size")).otherwise(F.coalesce("removed", zero)).alias("_tw_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("runs", zero)).alias("_tw_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("_tw_kept_sha"),
    )


def joined(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the union of spans, cut at 0 and n; spans that touch are one."""
    order = np.argsort(a, kind="stable")
    a, b = np.maximum(a[order], 0), np.maximum.accumulate(np.minimum(b[order], n))
    first = np.concatenate([[True], a[1:] > b[:-1]])
    return a[first], b[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(b) - 1]])]
