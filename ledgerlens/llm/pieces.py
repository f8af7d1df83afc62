"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text is a path through the lattice of vocabulary pieces; an arc's weight is the piece's score for a
unigram model.  A BPE model is the same lattice with weights 0 and minus infinity: a sequence is what BPE
gives exactly if each two neighbours are what BPE gives for their joint string, so an arc is open after
another only if the pair is.  Characters outside the vocabulary are arcs of their bytes.

A giant text is cut into chunks.  The state at a boundary is the piece over the character before it: how
far it reaches to the left and to the right.  For each chunk, the best weights from every state at its
start to every state at its end are a max-plus transfer matrix.  Matrices are combined associatively in a
tree, states are handed down it, and each chunk traces its own path back, apart from the others.

No piece holds a blank after another character, so paths part there: inside a chunk, words are scanned
once and remembered, and only the stretch before the first such place depends on the state at the start.
Word forms that a batch holds for the first time are scanned together, place by place in step: arcs from
a trie of the pieces, and what may follow what, come from arrays.

Defined cases: a null or empty text has no ids; the blank mark in a text reads as a blank, as it does in
the library; repeated rows are encoded like others; an empty table gives an empty result; other columns
are ignored.  Models with a normalization table or with user-defined pieces are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.llm.common import by_size, staged, worker_cache, worker_imports

BLANK = "▁"
#: Characters of a chunk; longer texts are scanned in parallel.
CHUNK = 16_384
#: Word forms of a generation, and pairs of pieces, that a worker remembers.
KNOWN_WORDS, KNOWN_PAIRS = 250_000, 200_000
#: Characters of word forms scanned in step; places that fewer forms reach are scanned one form at a time, and so many are always in step.
IN_STEP, FEW, ALWAYS = 250_000, 16, 64
#: Pairs of pieces judged at once, and the binary logarithm of the pairs remembered in arrays.
JUDGED, PAIR_BITS = 4096, 20
#: Odd multiplier that spreads keys over a table, by their upper bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
CLOSED = float("-inf")
FOREVER = float("inf")


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * SPREAD >> np.uint64(64 - bits)).astype(np.int64)


class Lookup:
    """Numbers from 0 by distinct keys from 0, for arrays of keys; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        slot = slots(keys, self.bits)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            put = self.keys[slot] == keys
            self.values[slot[put]] = values[put]
            keys, values, slot = keys[~put], values[~put], slot[~put] + 1 & (1 << self.bits) - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = slots(keys, self.bits)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        other = np.flatnonzero((held != keys) & (held >= 0))
        while len(other):
            slot[other] = slot[other] + 1 & (1 << self.bits) - 1
            held = self.keys[slot[other]]
            out[other] = np.where(held == keys[other], self.values[slot[other]], -1)
            other = other[(held != keys[other]) & (held >= 0)]
        return out


class Arrays:
    """The lattice of a BPE model as arrays: a trie of the pieces, and which piece may come after which."""

    def __init__(self, m: Model):
        self.m, self.text = m, {i: p for p, i in m.ids.items()}
        size = max(m.ids.values()) + 1
        nodes = {p: n for n, p in enumerate(sorted(m.begins))}
        self.first = np.full(0x110000, -1, np.int32)
        steps = []
        for p, n in nodes.items():
            if len(p) == 1:
                self.first[ord(p)] = n
            else:
                steps.append((nodes[p[:-1]] << 21 | ord(p[-1]), n))
        self.step = Lookup(*np.array(steps, np.int64).reshape(-1, 2).T)
        self.piece = np.array([m.ids.get(p, -1) for p in nodes], np.int64)
        self.arc = np.full(size, -1, np.int8)  # -1: not looked at yet
        # parts of a piece are pieces, or characters, which need not be pieces
        self.number = dict(m.ids)
        for p in m.ids:
            for c in p:
                self.number.setdefault(c, size + len(self.number))
        joins = [(self.number[p[:n]] << 24 | self.number[p[n:]], i) for p, i in m.ids.items()
                 for n in range(1, len(p)) if p[:n] in self.number and p[n:] in self.number]
        self.join = Lookup(*np.array(joins, np.int64).reshape(-1, 2).T)
        self.rank = np.full(size + 1, FOREVER)
        for p, i in m.ids.items():
            self.rank[i] = -m.scores[p]
        self.depth = np.full((2, size), -1, np.int8)  # -1: not looked at yet, 0: ranks do not rise
        self.part = np.full((2, size, m.longest), -1, np.int32)
        self.born = np.full((2, size, m.longest), FOREVER)
        self.dies = np.full((2, size, m.longest), CLOSED)
        self.told = np.full(1 << PAIR_BITS, -1, np.int64)

    def arcs(self, ids: np.ndarray) -> np.ndarray:
        state = self.arc[ids]
        if (state < 0).any():
            for i in np.unique(ids[state < 0]).tolist():
                self.arc[i] = self.m.is_arc(self.text[i])
            state = self.arc[ids]
        return state > 0

    def look(self, ids: np.ndarray, right: int) -> None:
        """Learn the parts at an edge of pieces."""
        for i in np.unique(ids[self.depth[right, ids] < 0]).tolist():
            edge = self.m.edge(self.text[i], bool(right)) or []
            self.depth[right, i] = len(edge)
            for d, (part, born, dies) in enumerate(edge):
                self.part[right, i, d], self.born[right, i, d], self.dies[right, i, d] = self.number[part], born, dies

    def judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``follows`` for pairs of ids."""
        self.look(left, 1)
        self.look(right, 0)
        told = np.ones(len(left), bool)
        for at in range(0, len(left), JUDGED):
            a, b = left[at:at + JUDGED], right[at:at + JUDGED]
            m, n = int(self.depth[1, a].max()), int(self.depth[0, b].max())
            born = np.maximum(self.born[1, a, :m, None], self.born[0, b, None, :n])
            row, i, j = np.nonzero(born < np.minimum(self.dies[1, a, :m, None], self.dies[0, b, None, :n]))
            a, b = a[row], b[row]
            rank = self.rank[self.join(self.part[1, a, i].astype(np.int64) << 24 | self.part[0, b, j])]
            told[at + row[(rank < self.dies[1, a, i]) & (rank <= self.dies[0, b, j])]] = False
        for k in np.flatnonzero((self.depth[1, left] == 0) | (self.depth[0, right] == 0)).tolist():
            told[k] = self.m.follows(self.text[int(left[k])], self.text[int(right[k])])
        return told

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces may come after others; -1 is a character that is no piece."""
        out = np.ones(len(left), bool)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        pairs = left[known] << 24 | right[known]
        slot = slots(pairs, PAIR_BITS)
        held = self.told[slot]
        told = held & 1 > 0
        new = np.flatnonzero(held >> 1 != pairs)
        if len(new):
            fresh, where = np.unique(pairs[new], return_inverse=True)
            answers = self.judge(fresh >> 24, fresh & (1 << 24) - 1)
            told[new] = answers[where]
            self.told[slots(fresh, PAIR_BITS)] = fresh << 1 | answers
        out[known] = told
        return out

    def lattice(self, chars: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and id of the arcs inside units; ``ends`` is the end of each character's unit."""
        at = np.arange(len(chars))
        node = self.first[chars].astype(np.int64)
        found = [(at, np.ones_like(at), np.where(node < 0, -1, self.piece[node]))]
        for size in range(2, self.m.longest + 1):
            more = (node >= 0) & (at + size <= ends[at])
            at, node = at[more], node[more]
            node = self.step(node << 21 | chars[at + size - 1])
            at, node = at[node >= 0], node[node >= 0]
            ids = self.piece[node]
            whole = np.flatnonzero(ids >= 0)
            whole = whole[self.arcs(ids[whole])]
            found.append((at[whole], np.full(len(whole), size), ids[whole]))
        starts, sizes, ids = map(np.concatenate, zip(*found))
        return starts, sizes, ids

    def units(self, units: list[str]) -> list[bytes]:
        """``Model.unit`` of many units, all in step; a space is a blank too."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).replace(" ", BLANK).encode("utf-32-le"), "<u4").astype(np.int64)
        stops = np.cumsum(lengths)
        begins = stops - lengths
        starts, sizes, ids = self.lattice(chars, np.repeat(stops, lengths))
        place = starts - np.repeat(begins, lengths)[starts]
        order = np.argsort(place.astype(np.min_scalar_type(int(lengths.max()))), kind="stable")
        starts, sizes, ids = starts[order], sizes[order], ids[order]
        cuts = np.cumsum(np.bincount(place)).tolist()
        last, back = np.full(len(chars), -1, np.int64), np.zeros(len(chars), np.int64)  # by an arc's last character
        for step, (a, b) in enumerate(zip([0, *cuts], cuts)):
            at, size, piece = starts[a:b], sizes[a:b], ids[a:b]
            if step:
                may = self.follows(last[at - 1], piece)
                at, size, piece = at[may], size[may], piece[may]
            stop = at + size - 1
            last[stop], back[stop] = piece, size
        used = np.zeros(len(chars), bool)
        at, begin = stops - 1, begins
        while len(at):
            used[at] = True
            at = at - back[at]
            more = at >= begin
            at, begin = at[more], begin[more]
        where = np.flatnonzero(used)
        out, counts = last[where], np.ones(len(where), np.int64)
        strange = np.flatnonzero(out < 0)
        if len(strange):
            kinds, kind = np.unique(chars[where[strange]], return_inverse=True)
            codes = [np.frombuffer(self.m.unknown_bytes(chr(c)), "<u4") for c in kinds.tolist()]
            counts[strange] = np.array([len(c) for c in codes])[kind]
            whole = np.repeat(out, counts)
            whole[whole < 0] = np.concatenate([codes[k] for k in kind.tolist()])
            out = whole
        total = np.concatenate([[0], np.cumsum(counts)])
        edges = (4 * total[np.searchsorted(where, stops)]).tolist()
        data = out.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *edges], edges)]


class Model:
    def __init__(self, path: str, unigram: bool | None = None):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models without normalization and with a leading blank are known")
        kinds = [p.type for p in proto.pieces]
        if any(k in (4, 5) for k in kinds):
            raise ValueError("user-defined and unused pieces are not known")
        self.unigram = proto.trainer_spec.model_type == 1 if unigram is None else unigram
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - 10.0
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.other = kinds.index(2)
        self.sounds = [p.piece.replace(BLANK, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else
                       " ⁇ ".encode() if p.type == 2 else b"" for p in proto.pieces]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.open: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool | None] = dict.fromkeys(self.ids)  # None: not looked at yet
        self.begins = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.codes = {p: np.array([i], "<u4").tobytes() for p, i in self.ids.items()}
        self.edges: dict[tuple[str, bool], list[tuple[str, float, float]] | None] = {}
        self.arrays: Arrays | None = None

    # the lattice
    def merges(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """BPE of a short string: join the best pair, the leftmost of equals, until no pair is a piece; and what was joined to what."""
        parts, joined = list(text), {}
        while len(parts) > 1:
            best = max(((self.scores.get(a + b, CLOSED), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == CLOSED:
                break
            i = -best[1]
            joined[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts, joined

    def edge(self, piece: str, right: bool) -> list[tuple[str, float, float]] | None:
        """Parts of a piece that stand at its left or right edge while it is joined, each with the rank at which it is
        born and the rank at which it is joined to more; None if ranks do not rise on the way."""
        key = (piece, right)
        if key not in self.edges:
            joined = self.merges(piece)[1]
            out, part, dies = [], piece, FOREVER
            while True:
                born = -self.scores[part] if len(part) > 1 else -1.0
                if born >= dies or BLANK * 2 in part:
                    out = None
                    break
                out.append((part, born, dies))
                if len(part) == 1:
                    break
                part, dies = joined[part][right], born
            self.edges[key] = out
        return self.edges[key]

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may come after ``left``: whether BPE of both together joins nothing across their border.

        Two parts that meet at the border at some time are joined if they are a piece that ranks before
        what else takes either of them; of equal ranks the leftmost goes first.
        """
        if self.unigram or left not in self.ids or right not in self.ids:
            return True
        told = self.open.get((left, right))
        if told is None:
            if len(self.open) > KNOWN_PAIRS:
                self.open.clear()
            ends, begins = self.edge(left, True), self.edge(right, False)
            if ends is None or begins is None:
                told = self.merges(left + right)[0] == [left, right]
            else:
                told = not any(
                    max(born, born_too) < min(dies, dies_too) and (rank := -self.scores.get(a + b, CLOSED)) < dies and rank <= dies_too
                    for a, born, dies in ends for b, born_too, dies_too in begins)
            self.open[(left, right)] = told
        return told

    def is_arc(self, piece: str) -> bool:
        told = self.whole.get(piece, False)
        if told is None:
            told = self.whole[piece] = self.unigram or self.merges(piece)[0] == [piece]
        return told or len(piece) == 1

    def weight(self, piece: str) -> float:
        return self.scores.get(piece, self.unknown) if self.unigram else 0.0

    def forward(self, text: str, start: int, end: int, first: str | None, past: int = 0) -> tuple[dict[int, float], dict[int, int]]:
        """Best weight and last arc's start for each place in (start, end + past] that is reached from ``start``.

        ``first`` is the piece before ``start``.  Arcs begin before ``end``; they may reach up to ``past`` beyond it.
        """
        best, back, whole = {start: 0.0}, {}, self.whole
        for stop in range(start + 1, min(end + past, len(text)) + 1):
            top, where = CLOSED, None
            for at in range(max(start, stop - self.longest), min(stop, end)):
                piece = text[at:stop]
                if whole.get(piece) is False or piece not in whole and at < stop - 1 or not self.is_arc(piece):
                    continue
                before = best.get(at)
                if before is None:
                    continue
                left = first if at == start else text[back[at]:at]
                if left is not None and not self.follows(left, piece):
                    continue
                total = before + self.weight(piece)
                if total > top:
                    top, where = total, at
                    if not self.unigram:
                        break  # what BPE gives is one path
            if where is not None:
                best[stop], back[stop] = top, where
        return best, back

    # ids
    def id_bytes(self, pieces: list[str]) -> bytes:
        return b"".join([self.codes.get(p) or self.unknown_bytes(p) for p in pieces])

    def unknown_bytes(self, piece: str) -> bytes:
        return np.array([self.bytes[b] for b in piece.encode()] if self.bytes else [self.other], "<u4").tobytes()

    def unit(self, text: str) -> bytes:
        """Ids of a stretch between places where paths part: ``forward`` for a BPE model, along the one open path."""
        if self.unigram:
            return self.id_bytes(self.path(text, 0, len(text), None))
        size, begins, whole = len(text), self.begins, self.whole
        back, last = [-1] * (size + 1), [""] * (size + 1)
        back[0] = 0
        for at in range(size):
            if back[at] < 0:
                continue
            left, stop = last[at], at + 1
            piece = text[at:stop]
            while True:
                if back[stop] < 0 and whole.get(piece, stop == at + 1) is not False and self.is_arc(piece) and (not at or self.follows(left, piece)):
                    back[stop], last[stop] = at, piece
                stop += 1
                if stop > size or piece not in begins:
                    break
                piece = text[at:stop]
        out, at = [], size
        while at:
            out.append(last[at])
            at = back[at]
        return self.id_bytes(out[::-1])

    def path(self, text: str, start: int, stop: int, first: str | None, past: int = 0, end: int | None = None) -> list[str]:
        """Pieces of the best path from ``start`` to ``stop``."""
        back = self.forward(text, start, stop if end is None else end, first, past)[1]
        cuts = [stop]
        while cuts[-1] != start:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, units: Iterable[str]) -> None:
        """Remember the ids of units, which are written with spaces for blanks."""
        fresh = []
        for unit in units:
            ids = self.older.get(unit)
            if ids is None:
                fresh.append(unit)
            else:
                self.known[unit] = ids
        fresh.sort(key=len)
        for _, part in by_size(fresh, IN_STEP):
            most = 0 if self.unigram else max(ALWAYS, len(part[-FEW]) if len(part) >= FEW else 0)
            together = [u for u in part if len(u) <= most]
            self.known.update((u, self.unit(u.replace(" ", BLANK))) for u in part[len(together):])
            if together:
                self.arrays = self.arrays or Arrays(self)
                self.known.update(zip(together, self.arrays.units(together)))

    def stretches(self, texts: list[str]) -> list[bytes]:
        """Ids of stretches that begin and end where paths part."""
        split = [UNIT.findall(t.replace(BLANK, " ")) for t in texts]
        self.learn(set(chain.from_iterable(split)).difference(self.known))
        return [b"".join(map(self.known.__getitem__, units)) for units in split]

    def words(self, text: str) -> bytes:
        return self.stretches([text])[0]

    def rest(self) -> None:
        if len(self.known) > KNOWN_WORDS:
            self.known, self.older = {}, self.known


#: A blank begins a unit, and so does a line end, which is in no piece of more than one character.
UNIT = re.compile("\n| +[^ \n]*|[^ \n]+")


def model(path: str, unigram: bool | None = None) -> Model:
    return worker_cache(f"pieces {path} {unigram}", lambda: Model(path, unigram))


def states_at(m: Model, text: str, place: int) -> list[tuple[int, int]]:
    """Arcs over the character before ``place``: reach to the left and to the right of it."""
    out = []
    for start in range(max(0, place - m.longest), place):
        for stop in range(place, min(len(text), start + m.longest) + 1):
            piece = text[start:stop]
            if m.is_arc(piece):
                out.append((place - start, stop - place))
    return out


def parting(text: str, start: int, end: int) -> tuple[int, int] | None:
    """First and last place in (start, end) where every path has a border: before a blank that follows another character."""
    places = [x.start() + 1 for x in PARTING.finditer(text, start, end)]
    return (places[0], places[-1]) if places else None


PARTING = re.compile(f"[^{BLANK}](?={BLANK})")


def transfer(m: Model, text: str, start: int, end: int, first_chunk: bool) -> list[tuple[int, int, int, int, float]]:
    """Max-plus matrix of the chunk [start, end) of ``text``: (left, right) at its start, the same at its end, best weight."""
    entries = [(0, 0)] if first_chunk else states_at(m, text, start)
    middle = parting(text, start + m.longest, end)
    reach = m.longest - 1

    def leave(best: dict[int, float], back: dict[int, int], base: float) -> list[tuple[int, int, float]]:
        return [(end - back[stop], stop - end, base + w) for stop, w in best.items() if stop >= end and stop in back and back[stop] < end]

    tail = None
    if middle:
        last = middle[1]
        inner = m.forward(text, middle[0], last, None)[0][last] if m.unigram and last > middle[0] else 0.0
        tail = leave(*m.forward(text, last, end, None, reach), inner)
    out = []
    for left, right in entries:
        at = start + right
        first = text[start - left:at] or None
        if at >= end and left:
            out.append((left, right, left + end - start, at - end, 0.0))
        elif tail is not None and middle and at <= middle[0]:
            gained = m.forward(text, at, middle[0], first)[0].get(middle[0]) if at < middle[0] else 0.0
            if gained is not None:
                out += [(left, right, a, b, gained + w) for a, b, w in tail]
        else:
            out += [(left, right, a, b, w) for a, b, w in leave(*m.forward(text, at, end, first, reach), 0.0)]
    return out


def combine(one: dict, two: dict) -> dict:
    """Max-plus product of sparse matrices {(from, to): weight}."""
    by_start: dict = {}
    for (a, b), w in two.items():
        by_start.setdefault(a, []).append((b, w))
    out: dict = {}
    for (a, b), w in one.items():
        for c, v in by_start.get(b, ()):
            if w + v > out.get((a, c), CLOSED):
                out[a, c] = w + v
    return out


def hand_down(matrices: list[dict]) -> list[tuple[tuple, tuple]]:
    """State before and after each chunk on the best path, through a tree of products."""
    tree = [matrices]
    while len(tree[-1]) > 1:
        low = tree[-1]
        tree.append([combine(*low[i:i + 2]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    # a text ends where its last piece ends
    left = max((weight, -leave[0]) for (_, leave), weight in tree[-1][0].items() if leave[1] == 0)[1]
    spans = [((0, 0), (-left, 0))]
    for low in reversed(tree[:-1]):
        below = []
        for i, (enter, leave) in enumerate(spans):
            pair = low[2 * i:2 * i + 2]
            if len(pair) == 1:
                below.append((enter, leave))
                continue
            choices = [(w + pair[1][b, leave], b) for (a, b), w in pair[0].items() if a == enter and (b, leave) in pair[1]]
            middle = max(choices)[1]
            below += [(enter, middle), (middle, leave)]
        spans = below
    return spans


def chunk_parts(m: Model, text: str, start: int, end: int, enter: tuple[int, int], leave: tuple[int, int]) -> tuple[bytes, str, bytes]:
    """Arcs that begin in the chunk, on the path between the two states: ids, a stretch between places where paths part, ids."""
    at, stop = start + enter[1], end + leave[1]
    final = end - leave[0]
    if final < start or at >= end:  # the arc over the end began before the chunk
        return b"", "", b""
    first = text[start - enter[0]:at] or None
    middle = parting(text, at, end)
    if not middle:
        return m.id_bytes(m.path(text, at, stop, first, stop - end, end)), "", b""
    head = m.id_bytes(m.path(text, at, middle[0], first)) if at < middle[0] else b""
    return head, text[middle[0]:middle[1]], m.id_bytes(m.path(text, middle[1], stop, None, stop - end, end))


def chunk_ids(m: Model, text: str, start: int, end: int, enter: tuple[int, int], leave: tuple[int, int]) -> bytes:
    """Ids of the arcs that begin in the chunk, on the path between the two states."""
    head, stretch, tail = chunk_parts(m, text, start, end, enter, leave)
    return head + m.words(stretch) + tail


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, unigram: bool | None = None) -> DataFrame:
    """doc_id, text and ids (little-endian 32-bit, as bytes) of every document."""
    worker_imports(docs.sparkSession)
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    m = model(path, unigram)
    if chunk < 4 * m.longest:
        raise ValueError("chunks must be longer than pieces")
    kind = dict(docs.dtypes)["doc_id"]
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.length(body).alias("size"))

    @F.pandas_udf("binary")
    def short(texts: pd.Series) -> pd.Series:
        own, out = model(path, unigram), []
        for _, part in by_size(texts.fillna("")):
            own.rest()
            out += own.stretches([" " + t if t else "" for t in part])
        return pd.Series(out, dtype=object)

    shorts = slim.filter(F.col("size") < chunk).select("doc_id", "text", short("text").alias("ids"))

    # giant texts: chunks with margins, as long as a piece, on both sides
    marked = slim.filter(F.col("size") >= chunk).withColumn("mark", F.xxhash64("text"))
    line = F.concat(F.lit(BLANK), F.translate("text", " ", BLANK))
    chunks = F.ceil((F.col("size") + 1) / chunk).cast("int")
    margin = m.longest
    parts = marked.select("doc_id", "mark", line.alias("line"), chunks.alias("chunks")).select(
        "doc_id", "mark", "line", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(
        "doc_id", "mark", "chunk", F.least(F.col("chunk") * chunk, F.lit(margin)).alias("start"),
        F.expr(f"substring(line, greatest(0, chunk * {chunk} - {margin}) + 1, least(chunk * {chunk}, {margin}) + {chunk + margin})").alias("part"),
        F.expr(f"least({chunk}, length(line) - chunk * {chunk})").alias("size"))
    parts = staged(parts.dropDuplicates(["doc_id", "mark", "chunk"]), "chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model(path, unigram)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                cells = transfer(own, r.part, r.start, r.start + r.size, r.chunk == 0)
                rows.append((r.doc_id, r.mark, r.chunk, [x for c in cells for x in c[:4]], [c[4] for c in cells]))
            yield pd.DataFrame(rows, columns=["doc_id", "mark", "chunk", "states", "weights"])

    cells = parts.mapInPandas(matrices, f"doc_id {kind}, mark bigint, chunk int, states array<int>, weights array<double>")

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        maps = [{((int(a), int(b)), (int(c), int(d))): w for (a, b, c, d), w in zip(np.asarray(s).reshape(-1, 4), ws)} for s, ws in zip(rows["states"], rows["weights"])]
        spans = hand_down(maps)
        out = rows[["doc_id", "mark", "chunk"]].reset_index(drop=True)
        out["path"] = [[*enter, *leave] for enter, leave in spans]
        return out

    told = staged(cells.groupBy("doc_id", "mark").applyInPandas(scan, f"doc_id {kind}, mark bigint, chunk int, path array<int>"), "states")
    same = F.expr("p.doc_id <=> t.doc_id and p.mark = t.mark and p.chunk = t.chunk")
    placed = parts.alias("p").join(told.alias("t"), same).select("p.*", "t.path")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model(path, unigram)
        for batch in batches:
            ids: list[bytes] = []
            for first, texts in by_size(batch["part"]):
                own.rest()
                found = []
                for r in batch.iloc[first:first + len(texts)].itertuples(index=False):
                    steps = [int(x) for x in r.path]
                    found.append(chunk_parts(own, r.part, r.start, r.start + r.size, tuple(steps[:2]), tuple(steps[2:])))
                heads, stretches, tails = zip(*found)
                ids += map(b"".join, zip(heads, own.stretches(stretches), tails))
            yield batch[["doc_id", "mark", "chunk"]].assign(ids=pd.Series(ids, batch.index, dtype=object))

    traced = placed.mapInPandas(trace, f"doc_id {kind}, mark bigint, chunk int, ids binary")
    # the ids of one text are as long as the text, which is one row too
    joined = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda c: F.hex(c["ids"]))
    giants = traced.groupBy("doc_id", "mark").agg(F.unhex(F.concat_ws("", joined)).alias("ids"))
    giants = marked.alias("m").join(giants.alias("g"), F.expr("m.doc_id <=> g.doc_id and m.mark = g.mark")).select("m.doc_id", "m.text", "g.ids")
    return shorts.unionByName(giants)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of ids (as bytes)."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def speak(rows: pd.Series) -> pd.Series:
        sounds = model(path).sounds
        out = [b"".join(map(sounds.__getitem__, np.frombuffer(r, "<u4").tolist())).decode("utf-8", "replace").removeprefix(" ") for r in rows]
        return pd.Series(out, dtype=object)

    return speak(ids)


def facts(encoded: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32 and whether decoding gives the text back."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return encoded.select(
        "doc_id", F.length(text).cast("bigint").alias("n_chars"), (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"), (decoded(F.col("ids")) == F.translate(text, BLANK, " ")).alias("round_trip"))
