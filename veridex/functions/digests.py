"""MD5 of many short texts at once: the numbers that columns.u draws from, as arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADDED = [np.uint32(int(2**32 * abs(math.sin(i + 1)))) for i in range(64)]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Steps after which the first word of the digest is known.
_HEAD = 61


def _padded(texts: pa.Array, room: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which texts, 16 words a block and text) for each number of blocks; `room` bytes in front are left zero."""
    texts = texts.cast(pa.large_binary())
    ends, data = (np.frombuffer(b, dtype=d) for b, d in zip(texts.buffers()[1:], (np.int64, np.uint8), strict=True))
    ends = ends[texts.offset : texts.offset + len(texts) + 1]
    size, found = np.diff(ends), []
    blocks = (room + size + 8) // 64 + 1
    for n in np.unique(blocks):
        which = np.flatnonzero(blocks == n)
        length, text = size[which], np.repeat(np.arange(len(which)), size[which])
        place = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
        raw = np.zeros((len(which), 64 * n), dtype=np.uint8)
        raw[text, room + place] = data[ends[which][text] + place]
        raw[np.arange(len(which)), room + length] = 0x80
        raw[:, -8:] = ((room + length) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
        found.append((which, np.ascontiguousarray(raw.view("<u4").T)))
    return found


class Texts:
    """Texts of which digests are wanted behind many prefixes of `room` bytes. What the prefixes share is worked out once."""

    def __init__(self, texts: pa.Array, room: int):
        self.n, self.room, self.touched = len(texts), room, -(-room // 4)
        self.parts = [(which, words, [words[16 * b + g] + k for b in range(len(words) // 16) for g, k in zip(_WORD, _ADDED, strict=True)]) for which, words in _padded(texts, room)]

    def heads(self, prefixes: list[bytes]) -> np.ndarray:
        """The first 32 bits of the MD5 of each prefix (row) with each text (column)."""
        raw = np.zeros((len(prefixes), 4 * self.touched), dtype=np.uint8)
        raw[:, : self.room] = np.frombuffer(b"".join(prefixes), dtype=np.uint8).reshape(len(prefixes), self.room)
        front, out = raw.view("<u4").T, np.empty((len(prefixes), self.n), dtype=np.uint32)
        for which, words, added in self.parts:
            state: list[np.ndarray] = [np.full((len(prefixes), len(which)), x, dtype=np.uint32) for x in _START]
            spare, blocks = np.empty_like(state[0]), len(words) // 16
            own = [front[g][:, None] | words[g] for g in range(self.touched)]
            for block in range(blocks):
                before = _START if block == 0 else [x.copy() for x in state]
                last = block == blocks - 1
                for i in range(_HEAD if last else 64):
                    at = 16 * block + _WORD[i]
                    state = _step(i, *state, spare, *((own[at], _ADDED[i]) if at < self.touched else (added[64 * block + i],)))
                if last:
                    np.add(state[1], before[0], spare)
                else:
                    state = [np.add(x, y, x) for x, y in zip(state, before, strict=True)]
            if len(which) == self.n:
                return spare.byteswap(inplace=True)
            out[:, which] = spare.byteswap(inplace=True)
        return out


def _step(i: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, t: np.ndarray, *added: np.ndarray) -> list[np.ndarray]:
    """One of the 64 steps of MD5 (RFC 1321), on arrays that it writes over."""
    if i < 16:
        np.bitwise_xor(c, d, t)
        np.bitwise_and(t, b, t)
        np.bitwise_xor(t, d, t)
    elif i < 32:
        np.bitwise_xor(b, c, t)
        np.bitwise_and(t, d, t)
        np.bitwise_xor(t, c, t)
    elif i < 48:
        np.bitwise_xor(b, c, t)
        np.bitwise_xor(t, d, t)
    else:
        np.invert(d, t)
        np.bitwise_or(t, b, t)
        np.bitwise_xor(t, c, t)
    np.add(a, t, a)
    for x in added:
        np.add(a, x, a)
    turn = _TURNS[i // 16][i % 4]
    np.left_shift(a, np.uint32(turn), t)
    np.right_shift(a, np.uint32(32 - turn), a)
    np.bitwise_or(a, t, a)
    np.add(a, b, a)
    return [d, a, b, c]
