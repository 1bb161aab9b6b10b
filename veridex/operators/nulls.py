"""Permutation and uniform nulls at full numbers of replicates, from counts whose size the 16 cells bound.

Sets of cells are 16-bit masks, so items shrink to counts of masks, of sizes, or of pairs of sizes before anything is
drawn. A replicate then costs the same for any number of items (H2, H3), at most 65,536 numbers a level of a tree over the empty sets
(H4), or a pass over the different values (H5). Replicates times blocks are dealt
out by Spark. Draws depend on seed, replicate and block alone and are exact for any totals (see functions.draws).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CELLS, share
from ..functions.draws import generator, share_of, split
from ..sources.shared import fresh_folder
from .evidence import POPCOUNT, between_item_similarity, pair_similarity

#: Items, or different values, of a block in permutations; items that are permuted one by one.
BLOCK, LEAF = 1 << 18, 1 << 14
#: Values that occur at most so often, on average in a block, are drawn one by one, others by counts.
FEW_EQUAL = 4


def replicated(spark: SparkSession, replicates: int, statistic: Callable[[int], float]) -> DataFrame:
    """(r, value): the statistic of each replicate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"r": pdf["id"], "value": [float(statistic(int(r))) for r in pdf["id"]]})

    slices = max(1, min(replicates // 10, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, replicates, 1, slices).mapInPandas(run, "r long, value double")


def uniform_sets(masks: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """H2: mean similarity of random sets of the observed sizes, against the observed mean."""
    sizes = np.zeros(CELLS + 1, dtype=np.int64)
    for k, n in masks.groupBy(F.bit_count("mask")).count().collect():
        sizes[k] = n
    by_size = [np.flatnonzero(POPCOUNT == k) for k in range(CELLS + 1)]

    def statistic(r: int) -> float:
        rng, counts = generator(seed, r), np.zeros(1 << CELLS)
        for k, members in enumerate(by_size):
            if sizes[k]:
                counts[members] = rng.multinomial(sizes[k], np.full(len(members), 1 / len(members)))
        return pair_similarity(counts)[1] or 0.0

    null = replicated(masks.sparkSession, replicates, statistic)
    both = null.crossJoin(F.broadcast(between_item_similarity(masks).select("mean_jaccard")))
    return both.agg(F.avg("value").alias("null_mean"), F.max("mean_jaccard").alias("observed"), share(F.count_if(F.col("value") >= F.col("mean_jaccard") - 1e-12), F.count("*")).alias("p_value"), F.count("*").alias("replicates"))


def _at_most(null: DataFrame, observed: float) -> DataFrame:
    return null.agg(F.lit(observed).alias("observed"), F.avg("value").alias("null_mean"), share(F.count_if(F.col("value") <= observed), F.count("*")).alias("p_value"), F.count("*").alias("replicates"))


def uniform_cells(items: DataFrame, replicates: int = 5000, seed: int = 0) -> DataFrame:
    """H3: empty cells that as many random cells of the same item hit, against those cited. items: (mask, empty_mask)."""
    both = F.bit_count(F.col("mask").bitwiseAND(F.col("empty_mask")))
    cells = items.groupBy(F.bit_count("mask").alias("k"), F.bit_count("empty_mask").alias("e")).agg(F.count("*").alias("n"), F.sum(both.cast("long")).alias("hit")).collect()
    laws = [(r["n"], np.array([comb(r["e"], h) * comb(CELLS - r["e"], r["k"] - h) / comb(CELLS, r["k"]) if h <= r["k"] else 0.0 for h in range(CELLS + 1)])) for r in cells]
    hits = np.arange(CELLS + 1)

    def statistic(r: int) -> float:
        rng = generator(seed, r)
        return sum(int(rng.multinomial(n, p / p.sum()) @ hits) for n, p in laws)

    return _at_most(replicated(items.sparkSession, replicates, statistic), float(sum(r["hit"] for r in cells)))


class _Node:
    """Empty sets (kinds with numbers of items) that are dealt together, and the classes of cited sets that they tell apart."""

    def __init__(self, kinds: np.ndarray, numbers: np.ndarray, masks: np.ndarray, leaf: int):
        shared, some = int(np.bitwise_and.reduce(kinds)), int(np.bitwise_or.reduce(kinds))
        # cells that all kinds share are hit whichever kind an item gets; only cells in which kinds differ tell cited sets apart
        self.own = POPCOUNT[masks & shared].astype(np.int64)
        self.masks, where = np.unique(masks & (some ^ shared), return_inverse=True)
        self.where, self.kinds, self.numbers, self.kids = where.astype(np.uint16), kinds & (some ^ shared), numbers, ()
        items = int(numbers.sum())
        self.work = min(len(masks), items)
        self.permuted = len(kinds) > 1 and items <= min(leaf, 4 * len(self.masks))
        if len(kinds) > 1 and not self.permuted:
            left = self._left()
            self.given = int(numbers[left].sum())
            self.kids = tuple(_Node(self.kinds[part], numbers[part], self.masks, leaf) for part in (left, ~left))
            self.work += sum(k.work for k in self.kids)

    def _left(self) -> np.ndarray:
        """The kinds without one cell, or the first half: whichever leaves fewest classes. The first never leaves more than there are."""
        cells = [(self.kinds >> c & 1) == 0 for c in range(CELLS)]
        cuts = [x for x in cells if 0 < x.sum() < len(x)] + [np.arange(len(self.kinds)) < len(self.kinds) // 2]
        differ = lambda k: POPCOUNT[np.bitwise_or.reduce(k) ^ np.bitwise_and.reduce(k)]
        return min(cuts, key=lambda x: 2 ** int(differ(self.kinds[x])) + 2 ** int(differ(self.kinds[~x])))

    def classes(self, counts: np.ndarray) -> np.ndarray:
        return np.bincount(self.where, weights=counts, minlength=len(self.masks)).astype(np.int64)  # exact below 2**53 items


class _Deal:
    """Cited sets are dealt to the empty ones down a binary tree over these."""

    def __init__(self, cited: np.ndarray, empty: np.ndarray, seed: int, block: int, leaf: int):
        masks, kinds = np.flatnonzero(cited), np.flatnonzero(empty)
        self.items, self.seed = cited[masks], seed
        self.root = _Node(kinds, empty[kinds], masks, leaf) if len(kinds) else None
        self.depth = max(0, int(np.ceil(np.log2(max(1, self.root.work / block))))) if self.root else 0

    def hits(self, r: int, b: int) -> int:
        """What replicate r hits in block b: down the block's own path, then below it. What a node hits by itself counts in its first block."""
        if not self.root:
            return 0
        node, number, counts, total = self.root, 1, self.items, 0
        for level in reversed(range(self.depth)):
            first = b & (2 << level) - 1 == 0
            if not node.kids:
                return total + (self._below(r, number, node, counts) if first else 0)
            total += int(node.own @ counts) if first else 0
            node, number, counts = self._kids(r, number, node, counts)[b >> level & 1]
        return total + self._below(r, number, node, counts)

    def _kids(self, r: int, number: int, node: _Node, counts: np.ndarray) -> tuple:
        counts = node.classes(counts)
        left = split(generator(self.seed, r, number), counts, node.given)
        return (node.kids[0], 2 * number, left), (node.kids[1], 2 * number + 1, counts - left)

    def _below(self, r: int, number: int, node: _Node, counts: np.ndarray) -> int:
        total = int(node.own @ counts)
        if node.permuted:
            own = np.repeat(node.masks, node.classes(counts))
            total += int(POPCOUNT[own & generator(self.seed, r, number).permutation(np.repeat(node.kinds, node.numbers))].sum())
        elif node.kids:
            total += sum(self._below(r, n, kid, c) for kid, n, c in self._kids(r, number, node, counts))
        return total


def shuffled_items(items: DataFrame, replicates: int = 5000, seed: int = 0, block: int = BLOCK, leaf: int = LEAF, count: str | None = None) -> DataFrame:
    """H4: empty cells hit when cited sets keep but items are permuted. items: (mask, empty_mask), any number of rows.

    Items shrink to counts of pairs of sets, in one pass. A replicate deals the cited sets to the empty ones down a binary tree, by draws
    without replacement, to single empty sets or to at most `leaf` items, which are permuted. Below a node only those cells count in
    which its empty sets differ, so cited sets fall together: a level of the tree never takes more than 65,536 numbers. Replicates times
    blocks of about `block` such numbers are dealt out. count: a column with the number of items that a row stands for.
    """
    n, path = F.col(count) if count else F.lit(1).cast("long"), fresh_folder(items.sparkSession, "pairs")
    items.groupBy("mask", "empty_mask").agg(F.sum(n).alias("n")).write.parquet(path)
    pairs = items.sparkSession.read.parquet(path)
    counts = [np.zeros(1 << CELLS, dtype=np.int64) for _ in range(2)]
    for c, column in zip(counts, ("mask", "empty_mask"), strict=True):
        for mask, m in pairs.groupBy(column).agg(F.sum("n")).collect():  # at most 65,536 rows
            c[mask] = m
    hit = F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col("empty_mask"))) * F.col("n"))
    observed = float(pairs.agg(F.coalesce(hit, F.lit(0))).first()[0])
    deal = _Deal(*counts, seed, block, leaf)
    units = replicated(items.sparkSession, replicates << deal.depth, lambda i: deal.hits(i >> deal.depth, i & (1 << deal.depth) - 1))
    null = units.groupBy(F.shiftright("r", deal.depth).alias("r")).agg(F.sum("value").alias("value"))
    return _at_most(null, observed)


def in_blocks(values: DataFrame, blocks: int) -> DataFrame:
    """(block, value, n), each block in a task of its own: values are few bytes but much work, and Spark would coalesce them by size."""
    return values.select(_block(blocks), "value", "n").repartitionByRange(4 * blocks, "block")  # bounds are sampled: more than blocks, so that no two share a range


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int").alias("block")


def permuted_labels(df: DataFrame, value: str, group: str, replicates: int = 20_000, seed: int = 0, block: int = BLOCK, count: str | None = None) -> DataFrame:
    """H5: difference of means of group over the rest, and the share of permutations at or above it.

    Equal values count together (count: a column with the number of rows that a row stands for), so rows may be of any number and
    a frequent value is one number. Values lie in blocks by their hash. A block learns what it gives to each replicate from the
    numbers on its own path of a tree over the blocks, draws its values, and adds them up; only sums are shuffled. Rows
    without value are left out, those without group are in the rest.
    """
    spark, n = df.sparkSession, F.col(count).cast("long") if count else F.lit(1).cast("long")
    inside = F.coalesce(F.col(group), F.lit(False))
    path = fresh_folder(spark, "values")
    whole = F.col(value).cast("double")
    df.where(whole.isNotNull()).groupBy(whole.alias("value")).agg(F.sum(n).alias("n"), F.sum(F.when(inside, n).otherwise(0)).alias("n_in")).write.parquet(path)
    values = spark.read.parquet(path)
    distinct, n_all, n_in, total, total_in = values.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_in"), F.lit(0)), F.sum(F.col("value") * F.col("n")), F.sum(F.col("value") * F.col("n_in"))).first()
    n_out = n_all - n_in
    observed = total_in / n_in - (total - total_in) / n_out if n_in and n_out else None
    blocks = max(1, -(-distinct // block), min(spark.sparkContext.defaultParallelism, distinct // 1000))
    sizes = np.zeros(blocks, dtype=np.int64)
    for b, m in values.groupBy(_block(blocks)).agg(F.sum("n")).collect():
        sizes[b] = m

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        pdf = pdf.sort_values("value")
        x, counts = pdf["value"].to_numpy(), pdf["n"].to_numpy(dtype=np.int64)
        takes = share_of(b, sizes, np.full(replicates, n_in), seed)
        single, sums = bool(counts.sum() <= FEW_EQUAL * len(x)), np.zeros(replicates)
        x = np.repeat(x, counts) if single else x
        for r, take in enumerate(takes.tolist()):
            rng = generator(seed, b, r, 0)
            sums[r] = x[rng.choice(len(x), take, replace=False, shuffle=False)].sum() if single else x @ split(rng, counts, take)
        return pd.DataFrame({"r": np.arange(replicates), "inside": sums})

    sums = in_blocks(values, blocks).groupBy("block").applyInPandas(run, "r int, inside double").groupBy("r").agg(F.sum("inside").alias("inside"))
    d = F.col("inside") / F.lit(float(n_in or 1)) - (F.lit(float(total or 0.0)) - F.col("inside")) / F.lit(float(max(n_out, 1)))
    each = sums.select(d.alias("d"))
    return each.agg(F.lit(observed).cast("double").alias("observed"), F.avg("d").alias("null_mean"), share(F.count_if(F.col("d") >= F.lit(observed)), F.count("*")).alias("p_value"), F.count("*").alias("replicates"))
