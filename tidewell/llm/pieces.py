"""SentencePiece encoding and decoding: N-best segmentation over a given vocabulary.

A text, with a blank before it, is cut into units that no piece crosses: a blank with what follows
it, and line breaks. Every path of the text's lattice passes the nodes between units, so a path of the
text is a path of each unit in a row, its score is their sum, and the search can go unit by unit.

The lattice of a unit is searched forward (Viterbi), which gives the best score from its start to
every place: exact heuristics for A-star from the end backward, where complete paths come off the heap
best first. With exact heuristics the first of them never leaves the arcs that made the forward scores,
so for the best path these arcs are followed, and no heap is needed. For more paths the forward pass
keeps what every unit's second best path loses. A path among the N best departs from the best one in
at most N - 1 units, and only in those that lose least: departing in any other unit loses at least as
much as departing in each of those N - 1 alone, which with the best path are N paths already. Those
units are searched by A-star for N paths each, which are combined to the N best of the text.

Scores are the vocabulary's own and add up. A character that is no piece itself is written as its
UTF-8 bytes, with the lowest score of any piece less 10. Pieces that the vocabulary scores as never
used are not in the lattice. Ties go to the path whose pieces, from the end, are shorter.

Units seen for the first time are searched together, those of some texts at once: the arcs of all of
them are found by their length and followed by the place they start from, in arrays.

Decoding is exact: ``decode(encode(x)) == x`` for every text, the sign for a blank included. Null
and empty texts have no pieces and score 0; long texts and long units are encoded whole; repeated
rows are encoded alike. Ids that the vocabulary does not have decode to nothing. Other columns pass through.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
NEVER = -1e8
PENALTY = 10.0


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    #: id -> bytes that it stands for; a blank for its sign
    texts: list[bytes]
    byte_ids: list[int]
    unknown: float = field(init=False)
    #: every beginning of a piece -> ((id,), score), or None where it is no piece itself
    begun: dict[str, tuple[tuple[int, ...], float] | None] = field(init=False)

    def __post_init__(self):
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - PENALTY
        self.begun = dict.fromkeys(p[:n] for p in self.pieces for n in range(1, len(p)))
        self.begun |= {p: ((i,), s) for p, (i, s) in self.pieces.items()}

    @staticmethod
    def read(path: str = MODEL) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, texts, byte_ids = {}, [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                texts.append(piece.replace(BLANK, " ").encode())
                if model.get_score(i) > NEVER:
                    pieces[piece] = (i, model.get_score(i))
        return Vocabulary(pieces, texts, byte_ids)

    def lattice(self, unit: str) -> tuple[list[float], list[list[tuple[int, float, tuple[int, ...]]]]]:
        """(best score from the start to every place, the arcs (from, score, ids) that end at every place)."""
        # the sign for a blank in the text itself is no blank: it matches no piece
        seen = unit.replace(BLANK, "\0") if BLANK in unit else unit
        if seen[0] == " ":
            seen = BLANK + seen[1:]
        size, begun = len(seen), self.begun
        best = [float("-inf")] * (size + 1)
        best[0] = 0.0
        ending: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for a in range(size):
            here = best[a]
            if begun.get(seen[a]) is None:
                ids = tuple([self.byte_ids[x] for x in (" " if a == 0 and unit[0] == " " else unit[a]).encode("utf-8", "surrogatepass")])
                ending[a + 1].append((a, self.unknown, ids))
                best[a + 1] = max(best[a + 1], here + self.unknown)
            for b in range(a + 1, size + 1):
                got = begun.get(seen[a:b], 0)
                if got:
                    ids, s = got
                    ending[b].append((a, s, ids))
                    if here + s > best[b]:
                        best[b] = here + s
                elif got == 0:
                    break
        return best, ending

    def paths(self, unit: str, most: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``most`` best (score, ids) of a unit, best first: A-star from the end, guided by the forward scores."""
        best, ending = self.lattice(unit)
        out: list[tuple[float, tuple[int, ...]]] = []
        heap = [(-best[-1], 0, len(best) - 1, 0.0, None)]
        made = 0
        while heap and len(out) < most:
            _, _, at, behind, tail = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((behind, tuple(ids)))
                continue
            for a, s, own in ending[at]:
                made -= 1  # of equal ones the last made goes first
                heapq.heappush(heap, (-(behind + s + best[a]), made, a, behind + s, (own, tail)))
        return out


def _tree(vocabulary: Vocabulary) -> dict:
    """char -> (the same for what may follow, packed id or None, score) over all pieces."""
    root: dict = {}
    for piece, (i, s) in vocabulary.pieces.items():
        level = root
        for k, c in enumerate(piece):
            last = k == len(piece) - 1
            children, packed, score = level.get(c, ({}, None, 0.0))
            level[c] = (children, np.int32(i).tobytes(), s) if last else (children, packed, score)
            level = children
    return root


class Arcs:
    """The pieces of many units at once: (beginning of a piece, next character) -> beginning, in a hash table of arrays."""

    def __init__(self, vocabulary: Vocabulary):
        names = list(vocabulary.begun)
        at = {"": 0} | {p: i for i, p in enumerate(names, 1)}
        keys = np.array([at[p[:-1]] << 21 | ord(p[-1]) for p in names], dtype=np.int64)
        bits = (4 * len(keys) + 4).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.child = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        who, slot = np.arange(len(keys)), self.slot(keys)
        while len(who):
            free = np.flatnonzero(self.keys[slot] < 0)
            taken, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[taken], self.child[taken] = keys[who[put]], who[put] + 1
            who, slot = np.delete(who, put), (np.delete(slot, put) + 1) & self.mask
        got = [None, *vocabulary.begun.values()]
        self.ids = np.array([x[0][0] if x else -1 for x in got], dtype=np.int32)
        self.scores = np.array([x[1] if x else 0.0 for x in got])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def after(self, keys: np.ndarray) -> np.ndarray:
        """The beginning that each key leads to; 0 where there is none."""
        slot = self.slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.child[slot], 0)
        at = np.flatnonzero((got != keys) & (got >= 0))
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & self.mask
            got = self.keys[slot]
            here = got == keys[at]
            out[at[here]] = self.child[slot[here]]
            more = ~here & (got >= 0)
            at, slot = at[more], slot[more]
        return out

    def of(self, chars: np.ndarray, left: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id, score) of all pieces; where no piece has one character, one with the id -1."""
        at, node, alone, length, found = np.arange(len(chars)), np.zeros(len(chars), dtype=np.int64), np.ones(len(chars), dtype=bool), 0, []
        while len(at):
            node = self.after(node << 21 | chars[at + length])
            ok = np.flatnonzero(node)
            at, node, length = at[ok], node[ok], length + 1
            ids = self.ids[node]
            whole = np.flatnonzero(ids >= 0)
            found.append((at[whole], np.full(len(whole), length), ids[whole], self.scores[node[whole]]))
            if length == 1:
                alone[at[whole]] = False
            more = np.flatnonzero(left[at] > length)
            at, node = at[more], node[more]
        bare = np.flatnonzero(alone)
        found.append((bare, np.ones(len(bare), dtype=np.int64), np.full(len(bare), -1, dtype=np.int32), np.full(len(bare), unknown)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The array with the values from a place on, with more room where they do not fit."""
    if at + len(values) > len(array):
        array = np.concatenate([array[:at], np.zeros(at // 2 + len(values), dtype=array.dtype)])
    array[at : at + len(values)] = values
    return array


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after the other."""
    end = np.cumsum(size)
    return np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def cut(text: str) -> list[str]:
    """The units of a text as they are kept: without their blank, or from a line break on."""
    return text.replace("\n", " \n").split(" ") if text else []


def unit_of(name: str) -> str:
    return name if name[:1] == "\n" else " " + name


class Units(dict):
    """name of a unit -> its number in arrays with the ids of the best path, its score, and what the second best loses. Up
    to a bound; of the units that reach it, the half that came most often stays."""

    MOST = 100_000
    #: Units searched at once, and the length up to which they are and are kept.
    BLOCK, LONG = 4096, 64

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.arcs = vocabulary, Arcs(vocabulary)
        self.bytes = [np.int32(i).tobytes() for i in vocabulary.byte_ids]
        self.ids, self.first, self.size, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores, self.losses, self.end = np.zeros(0), np.zeros(0), 0

    @cached_property
    def root(self) -> dict:
        return _tree(self.vocabulary)

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray, scores: np.ndarray, losses: np.ndarray) -> None:
        n = len(self)
        self.first, self.size = _put(self.first, n, self.end + np.cumsum(size) - size), _put(self.size, n, size)
        self.scores, self.losses, self.uses = _put(self.scores, n, scores), _put(self.losses, n, losses), _put(self.uses, n, np.zeros(len(names), np.int64))
        self.ids = _put(self.ids, self.end, ids)
        self.end += len(ids)
        self.update(zip(names, range(n, n + len(names)), strict=True))

    def forget(self) -> None:
        """Keeps the short units that came most often, half as many as the bound at most, and halves their counts."""
        names, n = list(self), len(self)
        short = np.flatnonzero(np.fromiter(map(len, names), np.int64, n) <= self.LONG)
        stay = short[np.argsort(-self.uses[short], kind="stable")[: self.MOST // 2]]
        ids, size, uses = self.ids[ranges(self.first[stay], self.size[stay])], self.size[stay], self.uses[stay]
        kept = [names[k] for k in stay.tolist()], ids, size, self.scores[stay], self.losses[stay]
        self.clear()
        self.end = 0
        self.add(*kept)
        self.uses[: len(stay)] = uses // 2

    def learn(self, names: list[str]) -> None:
        """Searches for those of the units that are not known yet."""
        new = [u for u in set(names).difference(self) if len(u) <= self.LONG]
        if len(self) and (len(self) + len(new) > self.MOST or self.end > 16 * self.MOST):
            self.forget()
            new = [u for u in set(names).difference(self) if len(u) <= self.LONG]
        for k in range(0, len(new), self.BLOCK):
            block = new[k : k + self.BLOCK]
            self.add(block, *self.searched([unit_of(u) for u in block]))

    def numbers(self, names: list[str]) -> np.ndarray:
        """The numbers of units; those not known yet are searched one by one."""
        out = np.fromiter(map(self.__getitem__, names), np.int64, len(names))
        n = np.bincount(out, minlength=len(self))
        self.uses[: len(n)] += n
        return out

    def __missing__(self, name: str) -> int:
        packed, score, lost = self.best_two(unit_of(name))
        self.add([name], np.frombuffer(packed, dtype="<i4"), np.array([len(packed) // 4]), np.array([score]), np.array([lost]))
        return self[name]

    def best_of(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        """What ``best_two`` gives for each of the units, searched together."""
        ids, size, scores, losses = self.searched(units)
        return [(x.astype("<i4").tobytes(), s, lost) for x, s, lost in zip(np.split(ids, np.cumsum(size)[:-1]), scores.tolist(), losses.tolist(), strict=True)]

    def searched(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the best paths in a row, how many each has, their scores, what the second best ones lose)."""
        own = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(u) for u in units])
        first = np.cumsum(size) - size
        chars = np.where(own == ord(BLANK), 0, own)
        chars[first[own[first] == ord(" ")]] = ord(BLANK)
        unit = np.repeat(np.arange(len(units)), size)
        at, length, ids, scores = self.arcs.of(chars, (first + size)[unit] - np.arange(len(own)), self.vocabulary.unknown)
        # arcs that start at one place of their units end apart, so all of them are followed at once
        place = at - first[unit[at]]
        order = np.argsort(place.astype(np.uint16) if int(size.max()) < 1 << 16 else place, kind="stable")
        at, length, ids, scores = at[order], length[order], ids[order], scores[order]
        begin = at + unit[at]
        end = begin + length
        best = np.full(len(own) + len(units), -np.inf)
        second, way = best.copy(), np.zeros(len(best), dtype=np.int64)
        best[first + np.arange(len(units))] = 0.0
        cuts = np.searchsorted(place[order], np.arange(int(size.max()) + 1))
        for lo, hi in itertools.pairwise(cuts.tolist()):
            a, b, s = begin[lo:hi], end[lo:hi], scores[lo:hi]
            x, was = best[a] + s, best[b]
            better = x >= was
            second[b] = np.where(better, np.maximum(was, second[a] + s), np.maximum(second[b], x))
            best[b] = np.where(better, x, was)
            way[b[better]] = np.arange(lo, hi)[better]
        # back from all ends; of a unit's arcs the one found last comes first
        last = first + np.arange(len(units)) + size
        now, who, path, whose = last, np.arange(len(units)), [], []
        while len(now):
            arc = way[now]
            path.append(arc)
            whose.append(who)
            now = begin[arc]
            more = now != first[who] + who
            now, who = now[more], who[more]
        path, whose = np.concatenate(path[::-1]), np.concatenate(whose[::-1])
        path = path[np.argsort(whose.astype(np.uint16) if len(units) <= 1 << 16 else whose, kind="stable")]
        flat, n = ids[path], np.ones(len(path), dtype=np.int64)
        bare = np.flatnonzero(flat < 0)
        raw = [[self.vocabulary.byte_ids[c] for c in chr(own[i]).encode("utf-8", "surrogatepass")] for i in at[path[bare]]]
        n[bare] = [len(x) for x in raw]
        offset = np.concatenate([[0], np.cumsum(n)])
        flat = np.repeat(flat, n)
        for k, x in zip(bare, raw, strict=True):
            flat[offset[k] : offset[k + 1]] = x
        total, ends = best[last], np.cumsum(np.bincount(whose, minlength=len(units)))
        return flat.astype(np.int32), np.diff(offset[ends], prepend=0), total, total - second[last]

    def best_two(self, unit: str) -> tuple[bytes, float, float]:
        """Forward Viterbi that keeps the two best scores of every place, and the way of the best."""
        # the sign for a blank in the text itself is no blank: it matches no piece
        seen = unit.replace(BLANK, "\0") if BLANK in unit else unit
        if seen[0] == " ":
            seen = BLANK + seen[1:]
        size, root, unknown, low = len(seen), self.root, self.vocabulary.unknown, float("-inf")
        best, second, way = [low] * (size + 1), [low] * (size + 1), [None] * (size + 1)
        best[0] = 0.0
        for a in range(size):
            one, two = best[a], second[a]
            node = root.get(seen[a])
            if node is None or node[1] is None:
                raw = (" " if a == 0 and unit[0] == " " else unit[a]).encode("utf-8", "surrogatepass")
                x, b = one + unknown, a + 1
                if x >= best[b]:
                    second[b] = max(best[b], two + unknown)
                    best[b], way[b] = x, (a, b"".join([self.bytes[c] for c in raw]))
                elif x > second[b]:
                    second[b] = x
            b = a
            while node is not None:
                b += 1
                children, packed, s = node
                if packed is not None:
                    x = one + s
                    if x >= best[b]:
                        y = two + s
                        second[b] = best[b] if best[b] > y else y
                        best[b], way[b] = x, (a, packed)
                    elif x > second[b]:
                        second[b] = x
                if b == size:
                    break
                node = children.get(seen[b])
        parts, b = [], size
        while b:
            b, packed = way[b]
            parts.append(packed)
        parts.reverse()
        return b"".join(parts), best[size], best[size] - second[size]


@dataclass
class Searched:
    #: ids of the best paths, and where those of each text end
    ids: np.ndarray
    ends: np.ndarray
    #: of each text (score, ids of the units that leave their best path), best first
    ways: list[list[tuple[float, dict[int, tuple[int, ...]]]]]
    #: where the ids of each unit begin, and the units of each text end
    place: np.ndarray
    units: np.ndarray

    def path(self, text: int, way: dict[int, tuple[int, ...]]) -> bytes:
        """The ids of a path of a text, packed."""
        parts, at = [], int(self.ends[text])
        for k in sorted(way):
            a, b = self.place[self.units[text] + k : self.units[text] + k + 2].tolist()
            parts += [self.ids[at:a], np.array(way[k], dtype=np.int32)]
            at = b
        return np.concatenate([*parts, self.ids[at : self.ends[text + 1]]]).astype("<i4").tobytes()

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all paths of all texts in a row, where those of each path end): stretches of the best paths' ids and of the units' that leave them."""
        first, size, cuts, own, end = [], [], [0], [], len(self.ids)
        place, ends = self.place, self.ends.tolist()
        for t, ways in enumerate(self.ways):
            unit = int(self.units[t])
            for _, way in ways:
                at = ends[t]
                for k in sorted(way):
                    ids = way[k]
                    a, b = place[unit + k : unit + k + 2].tolist()
                    first += (at, end)
                    size += (a - at, len(ids))
                    own += ids
                    end += len(ids)
                    at = b
                first.append(at)
                size.append(ends[t + 1] - at)
                cuts.append(len(size))
        size = np.array(size, dtype=np.int64)
        every = np.concatenate([self.ids, np.array(own, dtype=np.int32)])
        return every[ranges(np.array(first, dtype=np.int64), size)], np.concatenate([[0], np.cumsum(size)])[cuts]


class Encoder:
    #: Texts searched at once, and their characters: more than one text only up to these.
    TEXTS, CHARS = 64, 1 << 18

    def __init__(self, vocabulary: Vocabulary, most: int):
        self.vocabulary, self.most, self.units = vocabulary, most, Units(vocabulary)
        self.others: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def paths(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        got = self.others.get(unit)
        if got is None:
            got = self.vocabulary.paths(unit, self.most)
            if len(self.others) < 20_000 and len(unit) <= 64:
                self.others[unit] = got
        return got

    def searched(self, texts: list[str]) -> Iterator[Searched]:
        """The N best paths of the texts, those of some texts at once."""
        block: list[str] = []
        size = 0
        for text in texts:
            if len(block) == self.TEXTS or size + len(text) > self.CHARS:
                if block:
                    yield self.block(block)
                block, size = [], 0
            block.append(text)
            size += len(text)
        if block:
            yield self.block(block)

    def block(self, texts: list[str]) -> Searched:
        cuts = [cut(text) for text in texts]
        names = list(itertools.chain.from_iterable(cuts))
        self.units.learn(names)
        k = self.units.numbers(names)
        ends = np.cumsum([0, *map(len, cuts)])
        size = self.units.size[k]
        ids = self.units.ids[ranges(self.units.first[k], size)]
        scores, losses = self.units.scores[k], self.units.losses[k]
        ways = [self.ways(own, scores[a:b], losses[a:b]) for own, (a, b) in zip(cuts, itertools.pairwise(ends.tolist()), strict=True)]
        place = np.concatenate([[0], np.cumsum(size)])
        return Searched(ids, place[ends], ways, place, ends)

    def ways(self, names: list[str], scores: np.ndarray, losses: np.ndarray) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """(score, ids of the units that leave their best path) of the N best paths of a text, from its units' own."""
        score = float(sum(scores.tolist()))
        if not names or self.most == 1:
            return [(score, {})]
        # only the units that lose least by their second path can differ in the N best
        n = min(self.most - 1, len(losses))
        movable = np.argpartition(losses, n - 1)[:n]
        movable = movable[np.lexsort((movable, losses[movable]))]
        paths = {k: self.paths(unit_of(names[k])) for k in movable.tolist() if np.isfinite(losses[k])}
        ways: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for k, own in paths.items():
            ways = heapq.nsmallest(self.most, [*ways, *((loss + own[0][0] - s, (*way, (k, j))) for loss, way in ways for j, (s, _) in enumerate(own) if j)])
        return [(score - loss, {k: paths[k][j][1] for k, j in way}) for loss, way in ways]

    def encode_all(self, texts: list[str]) -> Iterator[list[tuple[float, bytes]]]:
        """What ``encode`` gives for each text."""
        for found in self.searched(texts):
            for t, ways in enumerate(found.ways):
                yield [(score, found.path(t, way)) for score, way in ways]

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The N best (score, ids as packed little-endian int32) of a text."""
        return next(self.encode_all([text]))

    @cached_property
    def spelt(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes that ids stand for, where those of each id begin, how many they are)."""
        size = np.array([len(x) for x in self.vocabulary.texts], dtype=np.int64)
        return np.frombuffer(b"".join(self.vocabulary.texts), dtype=np.uint8), np.cumsum(size) - size, size

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """What ``decode`` gives for the ids between each two of the ends."""
        raw, first, size = self.spelt
        place = np.concatenate([[0], np.cumsum(size[ids])])[ends]
        out = raw[ranges(first[ids], size[ids])]
        begin = place[:-1][np.diff(place) > 0]
        try:
            whole = bool((out[begin] == ord(" ")).all()) and bool(str(out.data, "utf-8") or True)
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in itertools.pairwise(ends.tolist())], pa.string())
        place = place - np.concatenate([[0], np.cumsum(np.diff(place) > 0)])
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(np.delete(out, begin)))

    def decode(self, ids: list[int]) -> str:
        texts = self.vocabulary.texts
        if ids and not 0 <= min(ids) <= max(ids) < len(texts):
            ids = [i for i in ids if 0 <= i < len(texts)]
        return b"".join(map(texts.__getitem__, ids)).decode("utf-8", "replace")[1:]


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<i4").tolist()


PATHS = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))


def encoder(spark: SparkSession, most: int = 4, path: str = MODEL):
    """A column function: text -> array<struct<score, ids>>, the N best segmentations."""
    shared = spark.sparkContext.broadcast(Vocabulary.read(path))

    @F.arrow_udf("array<struct<score: double, ids: array<int>>>")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(shared.value, most)
        for texts in parts:
            for k in range(0, len(texts), 256):
                part = [x or "" for x in texts[k : k + 256].to_pylist()]
                yield pa.array([[{"score": s, "ids": np.frombuffer(ids, dtype="<i4")} for s, ids in paths] for paths in own.encode_all(part)], PATHS)

    return encode


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def coder(spark: SparkSession, most: int = 4, path: str = MODEL, decoded: bool = True):
    """A column function: text -> struct<ids, scores, paths, decoded>: the ids of the best segmentation, the
    scores and the ids of the N best, best first, and the text that the best one's ids decode to; without
    ``decoded``, ids and scores alone."""
    shared = spark.sparkContext.broadcast(Vocabulary.read(path))

    @F.arrow_udf("struct<ids: array<int>, scores: array<double>" + ", paths: array<array<int>>, decoded: string>" * decoded + ">" * (not decoded))
    def code(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(shared.value, most)
        for texts in parts:
            for k in range(0, len(texts), 256):
                for x in own.searched([x or "" for x in texts[k : k + 256].to_pylist()]):
                    scores = np.array([s for ways in x.ways for s, _ in ways], dtype=np.float64)
                    n = np.cumsum([0, *map(len, x.ways)])
                    columns = {"ids": _lists(x.ends, x.ids), "scores": _lists(n, scores)}
                    if decoded:
                        ids, ends = x.paths()
                        columns["paths"] = pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), _lists(ends, ids))
                        columns["decoded"] = own.decode_all(x.ids, x.ends)
                    yield pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return code


def decoder(spark: SparkSession, path: str = MODEL):
    """A column function: array<int> of ids -> text."""
    shared = spark.sparkContext.broadcast(Vocabulary.read(path))

    @F.arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Encoder(shared.value, 1)
        for ids in parts:
            yield pa.array([own.decode(x or []) for x in ids.to_pylist()], pa.string())

    return decode


def best(paths: Column) -> Column:
    return F.element_at(paths, 1)
