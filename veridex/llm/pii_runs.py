"""Long runs of the semi-Markov field, a window of tokens at a time.

The same segments, features and sums as in pii.candidates: features of all segments of one length are worked out as arrays, from
states that grow by one token, and strings are built for different values alone. A forward pass keeps three numbers a token
(log sum, best value, choice of the best segment), a backward pass, which is needed only if the best path takes a segment, one
more; segments and their scores live as long as their window. So memory goes with a few bytes a token, and time with tokens.
"""

from __future__ import annotations

import re

import numpy as np

#: Tokens of a window.
WINDOW = 4096
#: Places of features of different values that are kept.
KEPT = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_TOKEN_PAIRS = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_LETTERS, _DIGITS, _SPACE, _WORD = 1, 2, 3, 4  # codes of symbols; others are 16 + their code point

# A domain after a mark, as states: none, mark, label, dot, label after a dot, then "[", "[.", "(", "(." after a label.
# Columns: other, label, at sign, dot, "[", "]", "(", ")".
_DOMAIN = np.array([
    [0, 0, 1, 0, 0, 0, 0, 0], [0, 2, 1, 0, 0, 0, 0, 0], [0, 2, 1, 3, 5, 0, 7, 0], [0, 4, 1, 0, 0, 0, 0, 0], [0, 4, 1, 3, 5, 0, 7, 0],
    [0, 0, 1, 6, 0, 0, 0, 0], [0, 0, 1, 0, 0, 3, 0, 0], [0, 0, 1, 8, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0, 0, 3],
], dtype=np.int8)


class Run:
    """The tokens of a run as arrays."""

    def __init__(self, text: str, before: str, field, kinds: int, most: int, place, luhn, kind_of):
        self.text, self.before, self.weights, self.kinds, self.most, self.place, self.luhn = text, before, field.weights, kinds, most, place, luhn
        pairs = np.fromiter((x for m in _TOKEN_PAIRS.finditer(text) for x in m.span()), dtype=np.int32)
        self.start, self.end = pairs[::2].copy(), pairs[1::2].copy()
        self.n = len(self.start)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        first = points[self.start]
        letter, digit = (first | 32) - 97 < 26, first - 48 < 10
        self.sym = np.where(letter, _LETTERS, np.where(digit, _DIGITS, 16 + first.astype(np.int64)))
        self.gap = np.r_[False, self.start[1:] > self.end[:-1]]
        size = self.end - self.start
        self.digits = np.where(digit, size, 0)
        value = np.zeros(self.n, dtype=np.int64)
        for k in range(3):
            inside = digit & (size > k)
            value[inside] = value[inside] * 10 + points[self.start[inside] + k] - 48
        self.octet = digit & (size < 4) & (value < 256)
        chars, code = np.unique(points, return_inverse=True)
        alpha = np.array([chr(c).isalpha() for c in chars], dtype=bool)
        self.alpha = letter | (~digit & alpha[code[self.start]])
        is_at = letter & (size == 2) & (points[self.start] == 97)
        is_at[is_at] = points[self.start[is_at] + 1] == 116
        char = lambda c: self.sym == 16 + ord(c)
        close = np.zeros(self.n, dtype=bool)
        for a, z in ("[]", "()"):
            close[2:] |= char(a)[:-2] & is_at[1:-1] & char(z)[2:] & ~self.gap[1:-1] & ~self.gap[2:]
        self.close = close
        before_char = np.r_[np.uint32(0), points][self.start]
        marked = np.r_[close[1:], False] | (before_char - 48 < 10) | (before_char == 64)
        self.has = digit | char("@") | (is_at & marked)
        self.fair = ~(char(".") | char(",") | char(":") | char(";"))
        self.kind = np.select([letter | digit | char("-"), char("@"), char("."), char("["), char("]"), char("("), char(")")], [1, 2, 3, 4, 5, 6, 7], 0).astype(np.int8)
        self.at, self.dot, self.plus, self.joins = char("@"), char("."), char("+"), char(".") | char("-")
        self.word = letter | digit
        # features of the first or last token alone
        name = {_LETTERS: "a", _DIGITS: "9"}
        shown = lambda s: name.get(s) or chr(s - 16)
        kinds_of = [kind_of(chr(c)) for c in chars]
        previous = np.where(self.start > 0, code[np.maximum(self.start - 1, 0)], -1)
        following = np.where(self.end < len(points), code[np.minimum(self.end, len(points) - 1)], -1)
        self.first, self.last = (self._named(self.sym, lambda s, f=f: f"{f}={shown(s)}") for f in ("first", "last"))
        wide = np.int64(1 << 21)
        self.left = self._named(self.sym * wide + previous + 1, lambda v: f"left={kinds_of[v % wide - 1] if v % wide else ''}:{shown(v // wide)}")
        self.right = self._named(self.sym * wide + following + 1, lambda v: f"right={shown(v // wide)}:{kinds_of[v % wide - 1] if v % wide else ''}")
        self._cache: dict[tuple, int] = {}
        self.all_digits = "".join(re.findall("[0-9]+", text))
        self.digits_before = np.cumsum(self.digits) - self.digits

    def _named(self, values: np.ndarray, name) -> np.ndarray:
        """Places of a feature whose value is one of few numbers."""
        found, back = np.unique(values, return_inverse=True)
        return np.array([self.place(name(int(v))) for v in found], dtype=np.int64)[back]

    def _hashed(self, kind: str, keys: np.ndarray, i: np.ndarray, j: np.ndarray, name) -> np.ndarray:
        """Places of a feature whose value a hash stands for; the string is built from one segment of each value."""
        found, at, back = np.unique(keys, return_index=True, return_inverse=True)
        out = np.empty(len(found), dtype=np.int64)
        for k, (key, row) in enumerate(zip(found.tolist(), at.tolist(), strict=True)):
            known = self._cache.get((kind, key))
            if known is None:
                if len(self._cache) >= KEPT:
                    self._cache.clear()
                known = self._cache[kind, key] = self.place(name(self.text[self.start[i[row]] : self.end[j[row] - 1]]))
            out[k] = known
        return out[back]

    def segments(self, low: int, high: int, top: int):
        """For each length: (starts, scores segment x kind) of the segments that begin in [low, high) and end at `top` or before."""
        m = high - low
        i = np.arange(low, high)
        zeros = lambda kind=np.int64: np.zeros(m, dtype=kind)
        seen, letters, plus, w_last = (zeros(bool) for _ in range(4))
        ats, dots, digits, numbers, spaces, octets, marks, domain, pending = (zeros() for _ in range(9))
        shape, coarse, groups = (zeros(_U) for _ in range(3))
        for length in range(1, self.most + 1):
            m = min(len(i), top - length + 1 - low)
            if m <= 0:
                return
            if m < len(i):
                i, seen, letters, plus, w_last, ats, dots, digits, numbers, spaces, octets, marks, domain, pending, shape, coarse, groups = (x[:m] for x in (i, seen, letters, plus, w_last, ats, dots, digits, numbers, spaces, octets, marks, domain, pending, shape, coarse, groups))
            t = i + length - 1
            gap = self.gap[t] if length > 1 else np.zeros(m, dtype=bool)
            sym, word, number = self.sym[t], self.word[t], self.sym[t] == _DIGITS
            seen, letters, plus = seen | self.has[t], letters | self.alpha[t], plus | self.plus[t]
            ats, dots, spaces, numbers, octets = ats + self.at[t], dots + self.dot[t], spaces + gap, numbers + number, octets + self.octet[t]
            digits = digits + self.digits[t]
            shape = np.where(gap, shape * _P + _U(_SPACE), shape) * _P + sym.astype(_U)
            groups = np.where(number, groups * _P + self.digits[t].astype(_U), groups)
            # words joined by single dots and hyphens are one in `coarse`; such a sign waits for what follows
            same = word & ~gap & w_last & (pending == 0)
            joined = word & ~gap & (pending > 0)
            waits = ~word & ~gap & w_last & (pending == 0) & self.joins[t]
            new = ~(same | joined | waits)
            grown = np.where(pending > 0, coarse * _P + pending.astype(_U), coarse)
            grown = np.where(gap, grown * _P + _U(_SPACE), grown) * _P + np.where(word, _WORD, sym).astype(_U)
            coarse, w_last = np.where(new, grown, coarse), np.where(new, word, w_last)
            pending = np.where(waits, sym, np.where(new | joined, 0, pending))
            closes = self.close[t] & (length > 2)
            marks = marks + self.at[t] + closes
            domain = np.where(closes, 1, _DOMAIN[np.where(gap, 0, domain), self.kind[t]])
            use = np.flatnonzero(seen & self.fair[i] & self.fair[t])
            if not len(use):
                continue
            si, st = i[use], t[use]
            sj = st + 1
            number_of = lambda values, name: self._named(values[use], name)
            long_enough = np.flatnonzero((digits[use] >= 16) & (digits[use] <= 19))
            checks = np.zeros(len(use), dtype=np.int64)
            for k in long_enough.tolist():
                at = int(self.digits_before[si[k]])
                checks[k] = self.luhn(self.all_digits[at : at + int(digits[use[k]])])
            final = np.where(pending > 0, coarse * _P + pending.astype(_U), coarse)
            places = [
                np.full(len(use), self.place("bias")), np.full(len(use), self.place(f"tokens={length}")), self.first[si], self.last[st], self.left[si], self.right[st],
                number_of(ats, lambda v: f"at={v}"), number_of(np.minimum(dots, 4), lambda v: f"dots={v}"), number_of(digits, lambda v: f"digits={v}"),
                number_of(np.minimum(numbers, 6), lambda v: f"numbers={v}"), number_of(np.minimum(spaces, 4), lambda v: f"spaces={v}"), number_of(letters, lambda v: f"letters={bool(v)}"),
                number_of(marks * 2 + (domain == 4), lambda v: f"mark={v // 2}:{bool(v % 2)}"), number_of((numbers == 4) & (octets == 4), lambda v: f"octets={bool(v)}"),
                self._named(checks, lambda v: f"luhn={bool(v)}"), number_of(digits * 2 + plus, lambda v: f"plus={bool(v % 2)}:{v // 2}"),
                self._hashed("shape", shape[use], si, sj, lambda s: "shape=" + re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", s))),
                self._hashed("coarse", final[use], si, sj, lambda s: "coarse=" + re.sub(r"w(?:[.-]w)*", "W", re.sub(r"[A-Za-z0-9]+", "w", s))),
                self._hashed("groups", np.where(letters[use], _U(2**64 - 1), groups[use]), si, sj, lambda s: f"groups={[len(n) for n in re.findall('[0-9]+', s)] if not any(c.isalpha() for c in s) else ''}"),
            ]
            scores = np.zeros((len(use), self.kinds))
            for p in places:
                scores += self.weights[:, p].T
            if self.before and low == 0 and si[0] == 0:
                scores[0] += self.weights[:, self.place(f"before={self.before}")]
            yield length, si, scores


def _by(rows: int, most: int) -> np.ndarray:
    return np.full((rows, most), -np.inf)


def likely(run: Run, least: float) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the segments of the best path that are likely enough."""
    n, most = run.n, run.most
    ahead, value = np.zeros(n + 1), np.zeros(n + 1)
    took, kind = np.zeros(n + 1, dtype=np.int8), np.zeros(n + 1, dtype=np.int8)
    for a in range(0, n, WINDOW):  # ends in (a, b]
        b = min(n, a + WINDOW)
        whole, best, of = _by(b - a, most), _by(b - a, most), np.zeros((b - a, most), dtype=np.int8)
        for length, i, scores in run.segments(max(0, a - most + 1), b, b):
            inside = i + length > a
            i, scores = i[inside], scores[inside]
            row = i + length - a - 1
            whole[row, length - 1], best[row, length - 1], of[row, length - 1] = np.logaddexp.reduce(scores, axis=1), scores.max(axis=1), scores.argmax(axis=1)
        some = np.isfinite(whole).any(axis=1)
        for r in range(b - a):
            t = a + r + 1
            ahead[t], value[t] = ahead[t - 1], value[t - 1]
            if some[r]:
                back = min(most, t)
                sums = ahead[t - back : t][::-1] + whole[r, :back]
                top = max(ahead[t - 1], sums.max())
                ahead[t] = top + np.log(np.exp(ahead[t - 1] - top) + np.exp(sums - top).sum())
                reach = value[t - back : t][::-1] + best[r, :back]
                k = int(reach.argmax())
                if reach[k] > value[t - 1]:
                    value[t], took[t], kind[t] = reach[k], k + 1, of[r, k]
    path, t = {}, n
    while t:
        if took[t]:
            path[t - int(took[t])] = (int(took[t]), int(kind[t]))
        t -= int(took[t]) or 1
    if not path:
        return []
    out, later, first = [], np.zeros(n + most + 1), min(path)
    for b in range(n, first, -WINDOW):  # starts in [a, b)
        a = max(0, b - WINDOW)
        whole, own = _by(b - a, most), {}
        for length, i, scores in run.segments(a, b, n):
            whole[i - a, length - 1] = np.logaddexp.reduce(scores, axis=1)
            own |= {int(x): scores[k] for k, x in enumerate(i.tolist()) if path.get(x, (0,))[0] == length}
        some = np.isfinite(whole).any(axis=1)
        for t in range(b - 1, a - 1, -1):
            later[t] = later[t + 1]
            if some[t - a]:
                sums = later[t + 1 : t + most + 1] + whole[t - a]
                top = max(later[t + 1], sums.max())
                later[t] = top + np.log(np.exp(later[t + 1] - top) + np.exp(sums - top).sum())
        for i, scores in own.items():
            length, k = path[i]
            if np.exp(min(0.0, ahead[i] + scores[k] + later[i + length] - ahead[n])) >= least:
                out.append((k, int(run.start[i]), int(run.end[i + length - 1])))
    return sorted(out, key=lambda x: x[1])
