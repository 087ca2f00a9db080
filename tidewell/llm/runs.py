"""Periodic runs of words in texts, by longest common extensions over a difference cover.

A run is a stretch of words that repeats with a smallest period, at least twice over, and that no
neighbouring word extends. Every run of period p covers two neighbouring multiples of p, so it shows
as two equal words p apart on the grid of p's multiples; over all p the grids have a harmonic number of
places. From each such pair the run is how far the two places agree, forwards and backwards.

How far is a longest common extension. Words are compared one by one for fewer than ``COVER`` words, which ends
most comparisons. Whoever agrees that long has by then met an offset at which both places are in a
difference cover of residues modulo ``COVER``: any two places have one. Only suffixes at covered places
are sorted, by doubling, and only for texts in which a comparison got that far; the rest of the extension is the least
common prefix between two ranks, from a sparse table.

Some texts are taken together, concatenated by falling number of words, so that the grid of a period visits
only texts of twice its length; memory is bounded by ``bytes``, or by one text, which is worked on as a whole. Null text has no words; texts without runs give none; nothing else is read. Each
row is a document of its own: repeated rows and ids, null ids included, give a row each.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .repeats import SparseMinimum, texts_in

#: A perfect difference set: of any two residues modulo 31 some shift takes both into it.
COVER, RESIDUES = 31, (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    """[a, b]: the least shift that takes residues a and b into the cover."""
    inside = np.isin(np.arange(2 * COVER) % COVER, RESIDUES)
    out = np.zeros((COVER, COVER), dtype=np.int64)
    for a in range(COVER):
        for b in range(COVER):
            out[a, b] = next(s for s in range(COVER) if inside[a + s] and inside[b + s])
    return out


SHIFTS = _shifts()


class Extensions:
    """Longest common extensions to the right in a sequence of word numbers that holds several texts.

    text: the number of each place's text, rising; no two texts have a word number in common.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.words, self.text = words, text
        self.indexed, self.index = text[:0], None
        # places past the end of the sequence are of no text
        self.owner = np.concatenate([text, np.full(COVER, -1, dtype=text.dtype)])
        self.padded = np.concatenate([words, np.arange(-1, -COVER - 1, -1, dtype=words.dtype)])

    def short(self, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many of the next ``COVER`` words from i and from j on agree within the texts ``own``."""
        out = np.zeros(len(i), dtype=np.int64)
        at, last = np.arange(len(i)), np.maximum(i, j)
        for step in range(COVER):
            at = at[(self.padded[i[at] + step] == self.padded[j[at] + step]) & (self.owner[last[at] + step] == own[at])]
            if not len(at):
                break
            out[at] = step + 1
        return out

    def long(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree where the first ``COVER`` do."""
        texts = np.unique(self.text[i])
        if not np.isin(texts, self.indexed).all():
            self.indexed, self.index = texts, self._sorted(texts)
        rank, least = self.index
        shift = SHIFTS[i % COVER, j % COVER]
        a, b = rank[i + shift], rank[j + shift]
        return shift + least.between(np.minimum(a, b), np.maximum(a, b))

    def _sorted(self, texts: np.ndarray) -> tuple[np.ndarray, SparseMinimum]:
        """Ranks of the sampled suffixes of ``texts`` by place, and the common prefixes of neighbouring ranks."""
        known = np.zeros(int(self.text[-1]) + 1, dtype=bool)
        known[texts] = True
        of = np.flatnonzero(known[self.text])  # these texts' places; the rest of the work is on them alone
        n = len(of)
        text = self.text[of]
        end = np.concatenate([np.flatnonzero(text[1:] != text[:-1]) + 1, [n]])
        end = end[np.searchsorted(end, np.arange(n), side="right")]
        # names of blocks of 1, 2, 4, 8 and 16 words in their order, and of ``COVER`` words from two that
        # overlap; a block that passes the end of its text equals no other
        name, width = self.words[of].astype(np.int64), 1
        while width * 2 <= COVER:
            name = _names(name, _after(name, width, end))
            width *= 2
        sample = np.flatnonzero(np.isin(of % COVER, RESIDUES))
        index = np.full(n, -1, dtype=np.int64)
        index[sample] = np.arange(len(sample))
        end = end[sample]
        name = _names(name[sample], _after(name, COVER - width, np.full(n, n))[sample])
        width, levels = COVER, []
        while True:
            levels.append(name)
            if name.max() + 1 == len(name):
                break
            # the suffix a block further on is sampled as well
            ahead = sample + width
            name = _names(name, np.where(ahead < end, name[index[np.minimum(ahead, n - 1)]] + 1, 0))
            width *= 2
        order = np.argsort(name)
        a, b = order[:-1], order[1:]
        prefix, pair = np.zeros(len(a), dtype=np.int64), np.flatnonzero(text[sample[a]] == text[sample[b]])
        for level in reversed(range(len(levels))):
            x, y = sample[a[pair]] + prefix[pair], sample[b[pair]] + prefix[pair]
            inside = (x < end[a[pair]]) & (y < end[b[pair]])
            same = inside & (levels[level][index[np.minimum(x, n - 1)]] == levels[level][index[np.minimum(y, n - 1)]])
            prefix[pair[same]] += COVER << level
        words = self.words[of]
        for _ in range(COVER):
            x, y = sample[a[pair]] + prefix[pair], sample[b[pair]] + prefix[pair]
            inside = (x < end[a[pair]]) & (y < end[b[pair]])
            pair = pair[inside & (words[np.minimum(x, n - 1)] == words[np.minimum(y, n - 1)])]
            prefix[pair] += 1
        rank = np.full(len(self.words), -1, dtype=np.int64)
        rank[of[sample[order]]] = np.arange(len(order))
        return rank, SparseMinimum(prefix)


def _after(name: np.ndarray, width: int, end: np.ndarray) -> np.ndarray:
    """The names ``width`` places further on, raised by one; 0 past the end."""
    ahead = np.arange(len(name)) + width
    return np.where(ahead < end, name[np.minimum(ahead, len(name) - 1)] + 1, 0)


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b), in their order."""
    order = np.lexsort((b, a))
    differs = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(a), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(differs)])
    return out


@dataclass(frozen=True)
class RunSpec:
    #: Words of the shortest run; it has twice its period at least in any case.
    shortest: int = 12
    #: Pairs of places that are extended together.
    pairs: int = 1 << 18
    #: Bytes of text that are worked on together, or one text.
    bytes: int = 1 << 23


def runs_of(words: np.ndarray, text: np.ndarray, spec: RunSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs in a sequence of texts by falling length, by start, then period."""
    n = len(words)
    found: list[np.ndarray] = []
    if n:
        size = np.bincount(text)
        reach = np.cumsum(size)
        ahead, back = Extensions(words, text), Extensions(words[::-1].copy(), (int(text[-1]) - text[::-1]).copy())
        wait: list[np.ndarray] = []
        open_: list[np.ndarray] = []

        def keep(x, p, f, b):
            good = f + b >= np.maximum(p, spec.shortest - p)
            x, p, f, b = x[good], p[good], f[good], b[good]
            found.append(np.unique(np.stack([x - b, x + p + f, p]), axis=1))

        def extend():
            x, p = np.concatenate(wait, axis=1)
            wait.clear()
            f = ahead.short(x, x + p, text[x])
            b = back.short(n - x, n - x - p, text[-1] - text[x])
            done = (f < COVER) & (b < COVER)
            keep(x[done], p[done], f[done], b[done])
            open_.append(np.stack([x[~done], p[~done], f[~done], b[~done]]))
            if sum(o.shape[1] for o in open_) >= 4 * spec.pairs:
                close()

        def close():
            x, p, f, b = np.concatenate(open_, axis=1)
            open_.clear()
            if (at := f == COVER).any():
                f[at] = ahead.long(x[at], x[at] + p[at])
            if (at := b == COVER).any():
                b[at] = back.long(n - x[at], n - x[at] - p[at])
            keep(x, p, f, b)

        held = 0
        texts = len(size)
        for p in range(1, int(size[0]) // 2 + 1):
            while texts and size[texts - 1] < max(2 * p, spec.shortest):
                texts -= 1
            if not texts:
                break
            m = int(reach[texts - 1])
            x = np.flatnonzero(words[: m - p : p] == words[p:m:p]) * p
            if len(x):
                wait.append(np.stack([x, np.full(len(x), p)]))
                held += len(x)
                if held >= spec.pairs:
                    extend()
                    held = 0
        if wait:
            extend()
        if open_:
            close()
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    # of one stretch the smallest period; others are its multiples
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    first = np.concatenate([[True], (every[:2, 1:] != every[:2, :-1]).any(0)])[: every.shape[1]]
    every = every[:, first]
    start, end, period = every[:, np.lexsort((every[2], every[0]))]
    return start, end, period


#: Columns of results: name, type in Spark, type in Arrow.
DIGESTS = [(f"_tw_{c}", "long", pa.int64()) for c in ("runs", "start", "length", "period")] + [(f"_tw_{c}", "string", pa.string()) for c in ("runs_sha", "collapsed_sha")]
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
COLLAPSED = [("_tw_text", "string", pa.string()), ("_tw_found", "array<struct<start: bigint, length: bigint, period: bigint>>", pa.list_(_RUN))]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words of all texts; each text has numbers of its own."""
    numbers = count()
    out = [np.fromiter(map(defaultdict(numbers.__next__).__getitem__, words), np.int32, len(words)) for words in texts]
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def with_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: RunSpec = RunSpec()) -> DataFrame:
    """Of every row its id as ``_tw_id`` and the columns of DIGESTS: the number of runs, the longest one, and
    digests of the list of all runs and of the text without repetitions, words joined by one space."""
    return _over_batches(docs, doc_id, text, spec, DIGESTS, _digests)


def collapsed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: RunSpec = RunSpec()) -> DataFrame:
    """Of every row its id as ``_tw_id``, ``_tw_text`` without repetitions, and ``_tw_found``, its runs."""

    def rows(words, runs):
        start, length, period = runs
        found = [{"start": a, "length": b, "period": c} for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
        return b" ".join(_kept(words, *runs)).decode("utf-8", "surrogatepass"), found

    return _over_batches(docs, doc_id, text, spec, COLLAPSED, rows)


def _kept(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(start):
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]


def _digests(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
    start, length, period = runs
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    best = (None, None, None)
    if len(start):
        i = np.lexsort((period, start, -length))[0]
        best = (int(start[i]), int(length[i]), int(period[i]))
    return len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(_kept(words, *runs))).hexdigest()


def _over_batches(docs: DataFrame, doc_id: str, text: str, spec: RunSpec, kind: list[tuple], row: Callable) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("_tw_id"), text_of(docs, text).cast("binary").alias("_tw_body"))

    def rows(texts: list[list[bytes]]) -> list[tuple]:
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        start, end, period = runs_of(numbered([texts[i] for i in order]), np.repeat(np.arange(len(order), dtype=np.int32), size[order]), spec)
        base = np.concatenate([[0], np.cumsum(size[order])])
        cut = np.searchsorted(start, base)
        out: list[tuple] = [()] * len(texts)
        for k, i in enumerate(order.tolist()):
            a, b = cut[k], cut[k + 1]
            out[i] = row(texts[i], (start[a:b] - base[k], end[a:b] - start[a:b], period[a:b]))
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bodies = texts_in(batch.column("_tw_body"))
            share = np.cumsum([len(b) for b in bodies]) // spec.bytes
            for part in np.split(np.arange(len(bodies)), np.flatnonzero(share[1:] != share[:-1]) + 1):
                if len(part):
                    out = rows([bodies[i].tobytes().split() for i in part.tolist()])
                    columns = {name: pa.array([x[c] for x in out], arrow) for c, (name, _, arrow) in enumerate(kind)}
                    yield pa.record_batch({"_tw_id": batch.column("_tw_id").slice(part[0], len(part))} | columns)

    return own.mapInArrow(run, ", ".join([f"_tw_id {own.schema['_tw_id'].dataType.simpleString()}", *(f"{name} {spark}" for name, spark, _ in kind)]))
