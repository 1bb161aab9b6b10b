"""Exact draws for totals of any size: hypergeometric and multinomial counts, and trees that share them out over blocks.

A draw of n out of N without replacement first takes every item with probability n/N, by one binomial number a kind. That gives
n plus or minus a few roots of N; what is missing is drawn from the rest, what is too many is drawn from those taken and
given back, in the same way, until a handful is left that is drawn one by one. Any probability gives the exact law, since all items
are alike; n/N only makes the rest small. So totals may exceed 10**9, and five or six rounds do.

Blocks share a draw by a binary tree: each node tells how many of its items lie in its left half. A block walks its own path from the
root, and all blocks agree, because a node's numbers come from the seed and the node alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: So many are drawn one by one.
FEW = 24


def generator(seed: int, *numbers: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *numbers])))


def _one_by_one(rng: np.random.Generator, pool: np.ndarray, n: int) -> np.ndarray:
    """How many of n different items, drawn from the pool, are of each kind."""
    ends = np.cumsum(pool)
    total, seen = int(ends[-1]), set()
    while len(seen) < n:
        seen.add(int(rng.integers(total)))
    return np.bincount(np.searchsorted(ends, sorted(seen), side="right"), minlength=len(pool))


def split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind n items drawn without replacement have (multivariate hypergeometric)."""
    out, pool, sign, want = np.zeros(len(counts), dtype=np.int64), counts, 1, int(n)
    while want:
        total = int(pool.sum())
        if want > total:
            raise ValueError(f"{n} of {counts.sum()} items")
        if want == total:
            return out + sign * pool
        if want <= FEW:
            return out + sign * _one_by_one(rng, pool, want)
        taken = rng.binomial(pool, want / total)
        out += sign * taken
        many = int(taken.sum()) - want
        # too many: give back some of those taken; too few: take more of the others
        pool, sign, want = (taken, -sign, many) if many > 0 else (pool - taken, sign, -many)
    return out


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of n items drawn from good + bad are good, for many draws at once."""
    good, bad, want = (np.array(x, dtype=np.int64) for x in np.broadcast_arrays(good, bad, n))
    out, sign = np.zeros(len(want), dtype=np.int64), np.ones(len(want), dtype=np.int64)
    while (open_ := np.flatnonzero(want > FEW)).size:
        g, b, w = good[open_], bad[open_], want[open_]
        p = w / (g + b)
        x, y = rng.binomial(g, p), rng.binomial(b, p)
        out[open_] += sign[open_] * x
        many = x + y - w
        good[open_], bad[open_] = np.where(many > 0, x, g - x), np.where(many > 0, y, b - y)
        sign[open_] *= np.where(many > 0, -1, 1)
        want[open_] = np.abs(many)
    for _ in range(FEW):
        open_ = np.flatnonzero(want > 0)
        if not open_.size:
            break
        hit = rng.integers(good[open_] + bad[open_]) < good[open_]
        out[open_] += sign[open_] * hit
        good[open_] -= hit
        bad[open_] -= ~hit
        want[open_] -= 1
    return out


def binomial(rng: np.random.Generator, left: int, right: int, n: np.ndarray) -> np.ndarray:
    """How many of n items drawn with replacement come from the left."""
    return rng.binomial(n, left / (left + right)) if left else np.zeros(len(n), dtype=np.int64)


def share_of(block: int, sizes: np.ndarray, n: np.ndarray, seed: int, law: Callable = hypergeometric) -> np.ndarray:
    """What a block gets of each of n draws from blocks of these sizes, by the numbers on its path alone."""
    ends, low, high, node, n = np.r_[0, np.cumsum(sizes)], 0, len(sizes), 1, np.array(n, dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left, right = int(ends[mid] - ends[low]), int(ends[high] - ends[mid])
        x = law(generator(seed, node), left, right, n) if left + right else np.zeros(len(n), dtype=np.int64)
        if block < mid:
            high, node, n = mid, 2 * node, x
        else:
            low, node, n = mid, 2 * node + 1, n - x
    return n
