"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

The transducer reads a piece byte by byte. Its state is the last settled token and the bytes after it; a token
boundary is settled once every way in which the piece may go on passes through it, and tokens are emitted then:
after a lookahead that the longest token bounds. States and transitions are made when first met and kept in flat
tables. All distinct pieces of a batch are read in step, so Python runs once a new transition and the rest is
gathered by index.

What decides a state's tokens is compatibility: two tokens may stand side by side if encoding their joined
bytes gives just these two. The encoding of a text is its one segmentation into tokens whose neighbours are
compatible, so the last token of each prefix follows from those of shorter prefixes.

Decoding runs tokens through an incremental UTF-8 state machine that holds back the bytes of an unfinished
character.

Nulls: a null text is encoded like an empty one, as no tokens. Pieces of any length are read by the same tables.
Repeated rows are returned as often as they occur; an empty table gives an empty result. Columns of docs that
are named like a new one (ids, decoded) give way to it, all others stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: States and compatible pairs are forgotten beyond these numbers, between pieces; results don't depend on them.
MAX_STATES, MAX_PAIRS = 120_000, 150_000
#: So many pieces are read in step; those with more bytes one after the other, by the same tables.
BLOCK_PIECES, LONG_PIECE = 16_384, 96
SLICE_BYTES = 3 << 20

#: Contexts that go with the same tokens are one where at most so many tokens are still possible.
ALIKE = 16

BYTES = [bytes([b]) for b in range(256)]

#: The last settled token (-1 at the start of a piece, -2 where it matters no more), the last token of each prefix of the
#: bytes after it (-1 for none), and where a token that isn't read to its end may have begun (place << 32 | node).
State = tuple[int, tuple[int, ...], tuple[int, ...]]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """BPE by its definition: merge the pair of least rank, leftmost first, until none is left. For short inputs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        pairs = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        best = min((p for p in pairs if p[0] is not None), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def gathered(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists (values between offsets) at rows, one after the other, with their offsets."""
    sizes = (offsets[1:] - offsets[:-1])[rows]
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    return values[at], np.r_[0, ends]


def binary_slices(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes between offsets, as Arrow binaries over the same data."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


class Transitions:
    """(state << 8 | byte) -> next state and emission: a hash table with open addressing in flat arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.next, self.emits = np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(T.U) * T._M1) >> T.U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where there is none."""
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        seen = self.keys[slots]
        left = np.flatnonzero(seen != keys)
        while len(left):
            empty = seen[left] < 0
            slots[left[empty]] = -1
            left = left[~empty]
            slots[left] = (slots[left] + 1) & mask
            seen[left] = self.keys[slots[left]]
            left = left[seen[left] != keys[left]]
        return slots

    def add(self, keys: np.ndarray, following: np.ndarray, emits: np.ndarray) -> None:
        """New keys, all different."""
        if (self.used + len(keys)) * 2 > 1 << self.bits:
            old = np.flatnonzero(self.keys >= 0)
            kept = self.keys[old], self.next[old], self.emits[old]
            self.__init__(max(self.bits + 1, int(2 * (self.used + len(keys))).bit_length()))
            self.add(*kept)
        self.used += len(keys)
        slots, mask, left = self._slots(keys), (1 << self.bits) - 1, np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            self.keys[slots[free]] = keys[free]  # of several for one slot the last one gets it
            got = free[self.keys[slots[free]] == keys[free]]
            self.next[slots[got]], self.emits[slots[got]] = following[got], emits[got]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & mask


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for i, t in self.tokens.items()}
        self.longest = max(self.sizes.values(), default=0)
        #: the tokens as a trie: (node << 8 | byte) -> next node, each node's token or -1, and the tokens below it (None
        #: for more than ALIKE)
        self.follow: dict[int, int] = {}
        self.token_at, above = [-1], [0]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                node, parent = self.follow.setdefault(node << 8 | byte, len(above)), node
                if node == len(above):
                    above.append(parent)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.below: list[tuple[int, ...] | None] = [()] * len(above)
        for node in range(len(above) - 1, 0, -1):
            own, parent = self.below[node], above[node]
            if own is not None and self.token_at[node] >= 0:
                own = (*own, self.token_at[node])
            both = None if own is None or self.below[parent] is None else (*self.below[parent], *own)
            self.below[parent] = both if both is not None and len(both) <= ALIKE else None
        #: left << 32 | right -> the token that the two make together
        self.joint: dict[int, int] = {}
        for t, i in ranks.items():
            for cut in range(1, len(t)):
                if (left := ranks.get(t[:cut])) is not None and (right := ranks.get(t[cut:])) is not None:
                    self.joint[left << 32 | right] = i
        self._compatible: dict[int, bool] = {}
        self._contexts: dict[int, int] = {}
        self._first_alike: dict[tuple, int] = {}
        self._halves: list[tuple[int, int] | None] = [None] * (max(self.tokens, default=0) + 1)
        self._forget()

    def _forget(self) -> None:
        self.table = Transitions()
        self._numbers: dict[State, int] = {}
        self._states: list[State] = []
        self._ends: list[int] = []
        self._emissions: dict[tuple[int, ...], int] = {(): 0}
        #: what is emitted, one after the other, and where each emission begins
        self._emitted: list[int] = []
        self._begins: list[int] = [0, 0]
        self.start = self._number((-1, (), ()))

    def _number(self, state: State) -> int:
        number = self._numbers.get(state)
        if number is None:
            number = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._ends.append(-1)
        return number

    def _context(self, context: int, node: int) -> int:
        """Of the contexts that go with the same tokens below the node the one met first."""
        found = self._contexts.get(context << 32 | node)
        if found is None:
            if len(self._contexts) > MAX_PAIRS:
                self._contexts.clear()
            barred = tuple(t for t in self.below[node] if not self._apart(context, t))
            found = self._contexts[context << 32 | node] = self._first_alike.setdefault((node, barred), context)
        return found

    def _emission(self, tokens: tuple[int, ...]) -> int:
        number = self._emissions.get(tokens)
        if number is None:
            number = self._emissions[tokens] = len(self._begins) - 1
            self._emitted += tokens
            self._begins.append(len(self._emitted))
        return number

    def _halves_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one last; (token, token) for a byte, (-1, -1) if no merge leads to it."""
        if self._halves[token] is None:
            parts = [BYTES[b] for b in self.tokens[token]]
            while len(parts) > 2:
                pairs = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get(a + b)) is not None]
                if not pairs:
                    break
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ids = [self.ranks.get(x) for x in parts]
            self._halves[token] = (-1, -1) if len(ids) > 2 or None in ids else (ids[0], ids[-1])
        return self._halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left; left -1 is the start of a piece.

        The two are undone merge by merge, latest first: they stay apart if at no time before the last undone
        merge the tokens at their border would have merged.
        """
        known = self._compatible.get(left << 24 | right)
        if known is None:
            if len(self._compatible) > MAX_PAIRS:
                self._compatible.clear()
            known = self._compatible[left << 24 | right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        halves, joint, before = self._halves, self.joint.get, 1 << 40
        right_half = (halves[right] or self._halves_of(right))[0]
        left_half = (halves[left] or self._halves_of(left))[1] if left >= 0 else left
        if right_half < 0 or left >= 0 > left_half:
            return False
        while left >= 0:
            if joint(left << 32 | right, before) < before:
                return False
            if left_half == left and right_half == right:
                return True
            # of equal merges the left one came first, so the right one is undone first
            if right_half == right or left_half != left and left > right:
                before, left = left, left_half
                left_half = (halves[left] or self._halves_of(left))[1]
            else:
                before, right = right + 1, right_half
                right_half = (halves[right] or self._halves_of(right))[0]
        return True

    def _path(self, lasts: tuple[int, ...], end: int) -> tuple[int, ...]:
        """The tokens of the prefix of length end."""
        path, sizes = [], self.sizes
        while end:
            token = lasts[end - 1]
            path.append(token)
            end -= sizes[token]
        return tuple(path[::-1])

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and what is emitted on the way."""
        context, lasts, begun = self._states[state]
        n, sizes, compatible, follow = len(lasts) + 1, self.sizes, self._compatible.get, self.follow.get
        if n == 1 or lasts[-1] >= 0:
            begun = (*begun, n - 1 << 32)
        last, alive = -1, []
        for start in begun:
            node = follow((start & 0xFFFFFFFF) << 8 | byte)
            if node is None:
                continue
            start >>= 32
            if last < 0 and (token := self.token_at[node]) >= 0:
                left = lasts[start - 1] if start else context
                fine = compatible(left << 24 | token)
                if self.compatible(left, token) if fine is None else fine:
                    last = token
            if self.below[node] != ():
                alive.append(start << 32 | node)
        lasts, out = (*lasts, last), 0
        if not alive or alive[0] >> 32:  # else the first pending token may still change
            ends = [x >> 32 for x in alive]
            if last >= 0:
                ends.append(n)
            settled = ends[0]
            for end in ends[1:]:  # the last boundary that all share
                while end != settled:
                    if end > settled:
                        end -= sizes[lasts[end - 1]]
                    else:
                        settled -= sizes[lasts[settled - 1]]
            if settled:
                out, context = self._emission(self._path(lasts, settled)), lasts[settled - 1]
                lasts, alive = lasts[settled:], [x - (settled << 32) for x in alive]
        if alive and not alive[0] >> 32:
            if self.below[alive[0]] is not None:
                context = self._context(context, alive[0])
        elif lasts:
            context = -2  # nothing that begins after it is open
        return self._number((context, lasts, tuple(alive))), out

    def _make(self, keys: np.ndarray) -> None:
        """New transitions (state << 8 | byte)."""
        made = [self._move(k >> 8, k & 255) for k in keys.tolist()]
        following, emits = np.array(made, dtype=np.int32).reshape(-1, 2).T
        self.table.add(keys, following, emits)

    def _end(self, state: int) -> int:
        """What is emitted where a piece ends in this state."""
        if self._ends[state] < 0:
            lasts = self._states[state][1]
            self._ends[state] = self._emission(self._path(lasts, len(lasts)))
        return self._ends[state]

    def read(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of a piece of any length, byte by byte."""
        out: list[int] = []
        state = self.start
        for byte in piece:
            if len(self._states) > MAX_STATES:
                here = self._states[state]
                self._forget()
                state = self._number(here)
            key = np.array([state << 8 | byte])
            slot = self.table.find(key)
            if slot[0] < 0:
                self._make(key)
                slot = self.table.find(key)
            state = int(self.table.next[slot[0]])
            emitted = self.table.emits[slot[0]]
            if emitted:
                out += self._emitted[self._begins[emitted] : self._begins[emitted + 1]]
        end = self._end(state)
        return (*out, *self._emitted[self._begins[end] : self._begins[end + 1]])

    def read_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their offsets, of all pieces: the bytes between offsets."""
        ids, sizes = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(offsets) - 1, BLOCK_PIECES):
            if len(self._states) > MAX_STATES:
                self._forget()
            own, offsets_of_own = self._read_block(data, offsets[at : at + BLOCK_PIECES + 1])
            ids.append(own)
            sizes.append(np.diff(offsets_of_own))
        return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(sizes))]

    def _read_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        long = int(np.searchsorted(-sizes[order], -LONG_PIECE, side="left"))
        order, long = order[long:], order[:long].tolist()
        starts, sizes, state = offsets[order], sizes[order], np.full(len(order), self.start, dtype=np.int64)
        pieces, emissions = [], []
        for step in range(int(sizes.max(initial=0))):  # a step is one byte of all pieces that have one
            live = int(np.searchsorted(-sizes, -step, side="left"))
            keys = state[:live] << 8 | data[starts[:live] + step]
            slots = self.table.find(keys)
            if (slots < 0).any():
                new = np.sort(keys[slots < 0])
                self._make(new[np.r_[True, new[1:] != new[:-1]]])
                slots = self.table.find(keys)
            emits = self.table.emits[slots]
            some = np.flatnonzero(emits)
            pieces.append(order[some])
            emissions.append(emits[some])
            state[:live] = self.table.next[slots]
        last, which = np.unique(state, return_inverse=True)
        pieces.append(order)
        emissions.append(np.array([self._end(s) for s in last.tolist()], dtype=np.int64)[which])
        pieces, emissions = np.concatenate(pieces), np.concatenate(emissions)
        begins = np.array(self._begins)
        ids, _ = gathered(np.array(self._emitted, dtype=np.int32), begins, emissions[np.argsort(pieces, kind="stable")])
        counts = np.bincount(pieces, weights=np.diff(begins)[emissions], minlength=len(offsets) - 1).astype(np.int64)
        if not long:
            return ids, np.r_[0, np.cumsum(counts)]
        read = [np.array(self.read(data[offsets[p] : offsets[p + 1]].tobytes()), dtype=np.int32) for p in long]
        ends = np.cumsum([0, *counts, *map(len, read)])
        rows = np.arange(len(counts))
        rows[long] = len(counts) + np.arange(len(long))
        return gathered(np.concatenate([ids, *read]), ends, rows)


# Classes of bytes in words that are cut without a pattern: letters (also U+00C0 to U+023F, two bytes each), digits, other
# signs, and single white-space characters; words with bytes of class 0 are left to the pattern.
_OTHER, _LETTER, _DIGIT, _SIGN, _BLANK, _SPACE = range(6)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[0x27, *range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xC9, 0x100)]] = _OTHER
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER
_CLASS[0x30:0x3A], _CLASS[0x09:0x0E], _CLASS[0x20] = _DIGIT, _BLANK, _SPACE


class Encoder:
    """Texts to ids: pieces by a pattern, and each distinct one through the transducer.

    With the usual pattern - runs of letters, digits or other signs, each with at most one space before, and white
    space - a single space between two other characters always begins a piece, so texts are cut there, and distinct
    words of common characters are cut where their class changes. For other patterns set spaced to False.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = True):
        self.transducer = Transducer(ranks)
        self.matches = regex.compile(pattern).finditer
        self.spaced = spaced

    def __call__(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode(data, np.array([0, len(data)]))[0].tolist()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their offsets, of the texts between offsets."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        if self.spaced:
            cut[self._word_starts(data, offsets)] = True
        cuts = np.flatnonzero(cut)
        ids, at = self._encode_words(binary_slices(data, cuts))
        return ids, at[np.searchsorted(cuts, offsets)]

    @staticmethod
    def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Single spaces between two characters that surely aren't white space."""
        padded = np.full(len(data) + 7, 0x20, dtype=np.uint8)
        padded[3:-4] = data
        at = np.flatnonzero(data == 0x20)
        blank = np.zeros(256, dtype=bool)
        blank[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True  # some white space begins with these
        c, b, a = padded[at], padded[at + 1], padded[at + 2]
        before = blank[a] & (a < 0x80) | (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (a >= 0x80) & (c >= 0xE1) & (c <= 0xE3)
        at = at[~before & ~blank[padded[at + 4]]]
        return at[~np.isin(at, offsets) & ~np.isin(at + 1, offsets)]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = words.dictionary_encode()
        data, offsets = T.utf8(coded.dictionary)
        cuts, dropped = self._pieces(data, offsets)
        pieces = binary_slices(data, cuts).dictionary_encode()
        own, own_offsets = T.utf8(pieces.dictionary)
        ids, at = self.transducer.read_all(own, own_offsets)
        ids, at = self._whole_tokens(own, own_offsets, ids, at)
        rows = pieces.indices.to_numpy()
        first = np.searchsorted(cuts, offsets)
        if len(dropped):  # what lies between two matches of the pattern
            ids, at = np.r_[ids], np.r_[at, at[-1]]
            rows = rows.copy()
            rows[np.searchsorted(cuts, dropped)] = len(at) - 2
        ids, at = gathered(ids, at, rows)
        return gathered(ids, at[first], coded.indices.to_numpy())

    def _whole_tokens(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A piece that is a token stays whole, even where no merges lead to it."""
        ranks, found = self.transducer.ranks, {}
        raw = data.tobytes()
        maybe = np.flatnonzero((np.diff(at) > 1) & (np.diff(offsets) <= self.transducer.longest))
        for p, a, z in zip(maybe.tolist(), offsets[maybe].tolist(), offsets[maybe + 1].tolist(), strict=True):
            if (whole := ranks.get(raw[a:z])) is not None:
                found[p] = whole
        if not found:
            return ids, at
        rows = np.arange(len(at) - 1)
        rows[list(found)] = len(rows) + np.arange(len(found))
        return gathered(np.r_[ids, np.array(list(found.values()), dtype=ids.dtype)], np.r_[at, at[-1] + 1 + np.arange(len(found))], rows)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces of the words begin (with the end of all), and the starts of stretches that no piece holds."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offsets] = True
        dropped: list[int] = []
        hard = np.diff(offsets) > 0
        if self.spaced and len(data):
            kind = _CLASS[data]
            sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
            kind[sign] = _OTHER
            leading = np.zeros(len(data), dtype=bool)
            leading[offsets[:-1][hard]] = True
            space = kind == _SPACE
            wide = (kind == _BLANK) | space
            odd = (kind == _OTHER) | space & ~leading
            odd[1:] |= wide[1:] & wide[:-1] & ~leading[1:]
            hard = np.diff(np.r_[0, np.cumsum(odd)][offsets]) > 0
            cut[1:-1] |= (kind[1:] != kind[:-1]) & ~(space & leading)[:-1] | (kind[1:] == _BLANK)
        for w in np.flatnonzero(hard).tolist():
            a, z = int(offsets[w]), int(offsets[w + 1])
            cut[a + 1 : z] = False
            word, seen = data[a:z].tobytes().decode(), 0
            for m in self.matches(word):
                if m.end() == m.start():
                    continue
                if m.start() > seen:
                    dropped.append(a)
                    a += len(word[seen : m.start()].encode())
                    cut[a] = True
                a += len(m[0].encode())
                cut[a] = True
                seen = m.end()
            if a < z:
                dropped.append(a)
        return np.flatnonzero(cut), np.array(dropped, dtype=np.int64)


# The UTF-8 machine: in its start state (0) no character is unfinished; each other state says which bytes may go on and
# which state follows. Fixed values of the encoding: state -> (least and largest byte that goes on, next state).
_GOES_ON = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
_LEADS = [(0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)]
STATES, WRONG, BROKEN = 8, 8, 16


def _utf8_table() -> np.ndarray:
    """state << 8 | byte -> next state; with WRONG the byte is none, with BROKEN the unfinished character before it is none."""
    start = np.full(256, WRONG, dtype=np.uint8)
    start[:0x80] = 0
    for low, high, state in _LEADS:
        start[low : high + 1] = state
    table = np.tile(start, (STATES, 1))
    for state, (low, high, following) in _GOES_ON.items():
        table[state] |= BROKEN
        table[state, low : high + 1] = following
    return table.reshape(-1)


UTF8 = _utf8_table()


class Utf8Machine:
    """Bytes to characters as they come. Wrong bytes become U+FFFD; the bytes of an unfinished character are held."""

    def __init__(self):
        self.state, self.held = 0, b""

    def feed(self, data: bytes) -> str:
        out, state, held = [], self.state, bytearray(self.held)
        for byte in data:
            step = int(UTF8[state << 8 | byte])
            if step & BROKEN:
                out.append("\ufffd")
                held.clear()
            state = step & (STATES - 1)
            if step & WRONG:
                out.append("\ufffd")
                continue
            held.append(byte)
            if not state:
                out.append(held.decode())
                held.clear()
        self.state, self.held = state, bytes(held)
        return "".join(out)

    def end(self) -> str:
        rest, self.state, self.held = "\ufffd" if self.held else "", 0, b""
        return rest


class Decoder:
    """Ids to text, by the UTF-8 machine's steps over whole tokens: one flat table, state x token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = np.zeros(max(self.tokens, default=0) + 1, dtype=np.int64)
        for i, t in self.tokens.items():
            self.sizes[i] = len(t)
        self.ends = np.cumsum(self.sizes)
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(self.sizes))), dtype=np.uint8)
        #: the state after a token, and whether a byte of it is wrong or breaks a character off
        self.after = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, len(self.sizes)))
        for step in range(int(self.sizes.max(initial=0))):
            on = np.flatnonzero(self.sizes > step)
            moved = UTF8[(self.after[:, on].astype(np.int64) & (STATES - 1)) << 8 | self.bytes[(self.ends - self.sizes)[on] + step]]
            self.after[:, on] = self.after[:, on] & ~np.uint8(STATES - 1) | moved

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """The text as it becomes known, token by token."""
        machine = Utf8Machine()
        for i in ids:
            yield machine.feed(self.tokens[i])
        if rest := machine.end():
            yield rest

    def __call__(self, ids: Iterable[int]) -> str:
        return "".join(self.pieces(ids))

    def _flawed(self, ids: np.ndarray, offsets: np.ndarray) -> set[int]:
        """The rows whose bytes aren't UTF-8. Tokens that begin and end between characters leave the start state as it
        is, so the machine is walked only from each other token on until it is back there."""
        leave = np.flatnonzero(self.after[0, ids] != 0).tolist()
        flawed, at, row, end = set(), 0, -1, 0
        for k in leave:
            if k < at:
                continue
            row = int(np.searchsorted(offsets, k, side="right")) - 1
            end, state, at = int(offsets[row + 1]), 0, k
            while at < end:
                state = int(self.after[state, ids[at]])
                at += 1
                if not state or state >= STATES:
                    break
            if state:
                flawed.add(row)
                at = end
        return flawed

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of lists of ids."""
        data, at = gathered(self.bytes, np.r_[0, self.ends], ids)
        cuts, flawed = at[offsets], self._flawed(ids, offsets)
        if not flawed:
            return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        raw = data.tobytes()
        return pa.array([self(ids[offsets[r] : offsets[r + 1]].tolist()) if r in flawed else raw[cuts[r] : cuts[r + 1]].decode() for r in range(len(offsets) - 1)], pa.string())


_MADE: dict = {}


def _once(key, make):
    """One encoder and decoder a worker process, whatever number of tasks it runs."""
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]


def _encode_batches(data, pattern: str, spaced: bool, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = data.value
        encoder = _once(("encode", hash(raw), pattern, spaced), lambda: Encoder(read_ranks(raw), pattern, spaced))
        for part in T.slices(batches, "text", SLICE_BYTES):
            ids, offsets = encoder.encode(*T.utf8(part.column("text")))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            columns = {n: part.column(n) for n in part.schema.names if n not in ("ids", "text")} | {"ids": ids}
            if decoded:
                decoder = _once(("decode", hash(raw)), lambda: Decoder(read_ranks(raw)))
                columns["decoded"] = decoder.texts(ids.values.to_numpy(), offsets)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return T.releasing(run)


def _decode_batches(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = data.value
        decoder = _once(("decode", hash(raw)), lambda: Decoder(read_ranks(raw)))
        for batch in batches:
            at, offsets = 0, batch.column("ids").offsets.to_numpy()
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES // 4, side="right")) - 1)
                part = batch.slice(at, end - at)
                column, at = part.column("ids"), end
                own = column.offsets.to_numpy()
                texts = decoder.texts(column.flatten().to_numpy(zero_copy_only=False), own - own[0])
                columns = {n: part.column(n) for n in part.schema.names if n != "decoded"} | {"decoded": texts}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return T.releasing(run)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", spaced: bool = True, decoded: bool = False) -> DataFrame:
    """docs without its text, with ids array<int>. ranks_path is read on the driver; its bytes go to the executors once.

    spaced: see Encoder; False for patterns in which a space may end a piece. decoded: the ids are decoded as well, as by
    decode, while they are at hand.
    """
    with open(ranks_path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    new = ["ids", "decoded"] if decoded else ["ids"]
    keep = [F.col(c) for c in docs.columns if c not in (text, "text", *new)]
    source = docs.select(*keep, F.coalesce(text, F.lit("")).alias("text"))
    schema = source.drop("text").select("*", F.array().cast("array<int>").alias("ids"), *[F.lit("").alias(c) for c in new[1:]]).schema
    return source.mapInArrow(_encode_batches(data, pattern, spaced, decoded), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with its ids as text, in column decoded."""
    with open(ranks_path, "rb") as file:
        data = encoded.sparkSession.sparkContext.broadcast(file.read())
    source = encoded.drop("decoded").select("*", F.lit("").alias("decoded"))
    return source.mapInArrow(_decode_batches(data), source.schema)


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded (doc_id, ids), decoding the ids where that isn't done yet."""
    out = encoded if "decoded" in encoded.columns else decode(encoded.select("doc_id", "ids"), ranks_path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
