"""Seeded selection, controls and nulls. Draws depend on seed and ids alone, never on partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import CELLS, bit, mask_of, share, u
from ..sources.shared import fresh_folder
from .evidence import POPCOUNT, between_item_similarity
from .ranks import with_ahead


def first_n_per_class(df: DataFrame, label: str, ordinal: str, n: int) -> DataFrame:
    """The first n rows of each class in stream order, with `short`: whether the class has fewer."""
    w = Window.partitionBy(label).orderBy(ordinal)
    found = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return found.withColumn("short", F.count("*").over(Window.partitionBy(label)) < n)


def stratified_select(items: DataFrame, allocation: DataFrame, seed: int, strata: list[str], rich_column: str, id_column: str = "image_id") -> DataFrame:
    """From each stratum, n items of the allocation: half of them (rounded up) rich, all if n is 2 or 3, none if less.

    Rich items have rich_column true. Within a class items are taken by a seeded hash.
    """
    n = F.col("n")
    rich_quota = F.when(n >= 4, F.ceil(n / 2)).when(n >= 2, n).otherwise(0).cast("long")
    quota = F.when(F.col(rich_column), rich_quota).otherwise(n - rich_quota)
    w = Window.partitionBy(*strata, rich_column).orderBy(u(seed, id_column), id_column)
    ranked = items.join(allocation, strata).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= quota)


def seeded_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows by seeded hash, numbered from 1 (a top-k report)."""
    top = df.withColumn("draw", u(seed, *ids)).orderBy("draw", *ids).limit(n)
    return top.withColumn("sample_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("draw", *ids)))


def blinded_sample(items: DataFrame, n: int, seed: int, ids: list[str], shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): a rating sheet with anonymous ids and blank ratings, and the table that undoes it."""
    s = seeded_sample(items, n, seed, *ids).withColumn("rating_id", F.format_string("R%04d", "sample_no"))
    blank = [F.lit("").alias(c) for c in ("presence", "relevance", "support", "notes")]
    return s.select("rating_id", *shown, *blank), s.select("rating_id", *ids)


def seeded_shuffle(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    """All rows in a reproducible order, by a range sort, with their draw."""
    return df.withColumn("draw", u(seed, *ids)).orderBy("draw", *ids)


def subsets(spark: SparkSession, k: int | None = None) -> DataFrame:
    """All sets of cells as (subset, size); 65,536 rows, or those of size k."""
    s = spark.range(1 << CELLS).select(F.col("id").alias("subset"), F.bit_count("id").alias("size"))
    return s if k is None else s.where(F.col("size") == k)


@lru_cache
def _choices(pool: int, taken: int) -> np.ndarray:
    """All sets of `taken` of `pool` places, a row of 0 and 1 each; at most 495 where controls need them."""
    rows = [[i in c for i in range(pool)] for c in combinations(range(pool), taken)]
    return np.array(rows, dtype=np.int64).reshape(-1, pool)


def controls(mask: np.ndarray, tissue: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """(overlap, gap, tied sets) of the best controls of targets (n masks of one size, n x 16 shares of tissue).

    Overlap is least if the control takes uncited cells first. Up to 8 cells it lies in those alone, beyond it takes all of them, and
    cited ones for the rest. So only sets within one pool of 8 to 16 cells are compared, all targets at once.
    """
    k = int(POPCOUNT[mask[0]])
    bits = (mask[:, None] >> np.arange(CELLS)) & 1
    pool_is = 0 if k <= CELLS // 2 else 1  # uncited, or cited, cells
    cells = np.argsort(bits != pool_is, axis=1, kind="stable")[:, : CELLS - k if pool_is == 0 else k]
    choices = _choices(cells.shape[1], k if pool_is == 0 else 2 * k - CELLS)
    fixed = np.zeros(len(mask), dtype=np.int64) if pool_is == 0 else (1 << CELLS) - 1 - mask
    area = np.take_along_axis(tissue, cells, axis=1) @ choices.T + ((1 - bits) * tissue).sum(axis=1, keepdims=True) * pool_is
    gap = np.round(np.abs(area - (bits * tissue).sum(axis=1, keepdims=True)), 6)
    least = gap.min(axis=1)
    tied = gap == least[:, None]
    # only the sets that tie are written out
    target, choice = np.nonzero(tied)
    sets = ((1 << cells)[target] * choices[choice]).sum(axis=1) + fixed[target]
    ends = np.r_[0, np.cumsum(tied.sum(axis=1))].astype(np.int32)
    return np.full(len(mask), max(0, 2 * k - CELLS)), least, pa.ListArray.from_arrays(pa.array(ends), pa.array(sets))


#: Targets that are compared at once.
TARGETS = 4096


def matched_control(targets: DataFrame, coverage: DataFrame, seed: int) -> DataFrame:
    """For each target (image_id, mask) the other set of as many cells that overlaps least, then is nearest in tissue.

    Targets of one size are compared as one array (see controls); ties go by a seeded hash, then the smaller set. A target of
    no or of all 16 cells has no other set, one of an image without 16 cells none that is known: no control.
    """
    tissue = coverage.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_idx", "tissue_pct"))), lambda x: x["tissue_pct"]).alias("tissue"))
    rows = targets.select("image_id", "mask").join(tissue, "image_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", "mask", "overlap", "tissue_gap", "tied"]
        for batch in batches:
            size = POPCOUNT[batch.column("mask").to_numpy()]
            whole = pa.compute.equal(pa.compute.list_value_length(batch.column("tissue")), CELLS).fill_null(False).to_numpy(zero_copy_only=False)
            known = whole & (size > 0) & (size < CELLS)
            rest = batch.filter(pa.array(~known))
            none = [pa.nulls(rest.num_rows, kind) for kind in (pa.int64(), pa.float64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*rest.columns[:2], *none], names=names)
            for k in np.unique(size[known]):
                same = batch.filter(pa.array(known & (size == k)))
                for i in range(0, same.num_rows, TARGETS):
                    part = same.slice(i, TARGETS)
                    shares = part.column("tissue").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, CELLS)
                    overlap, gap, tied = controls(part.column("mask").to_numpy(), shares)
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(overlap), pa.array(gap), tied], names=names)

    base = rows.select("image_id", "mask").schema
    found = rows.mapInArrow(run, T.StructType([*base.fields, *T._parse_datatype_string("overlap long, tissue_gap double, tied array<long>").fields]))
    name = lambda s: F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("image_id").cast("string"), s.cast("string"))), 1, 8)
    drawn = F.array_min(F.transform("tied", lambda s: F.struct(name(s).alias("draw"), s.alias("set"))))["set"]
    best = F.when(F.size("tied") == 1, F.get("tied", F.lit(0))).otherwise(drawn)
    return found.select("image_id", "mask", best.alias("control_mask"), "overlap", "tissue_gap")


def random_control(targets: DataFrame, seed: int) -> DataFrame:
    """For each target (image_id, mask) as many random cells, uncited ones first."""
    cells = targets.select("image_id", "mask", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell_idx"))
    cited = F.col("mask").bitwiseAND(bit("cell_idx")) != 0
    w = Window.partitionBy("image_id").orderBy(cited, u(seed, "image_id", "cell_idx"), "cell_idx")
    kept = cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.bit_count("mask"))
    control = kept.groupBy("image_id", "mask").agg(F.bit_or(bit("cell_idx")).alias("control_mask"))
    return control.withColumn("overlap", F.bit_count(F.col("mask").bitwiseAND(F.col("control_mask"))).cast("long"))


def _drawn(df: DataFrame, replicates: int, seed: int, size: str, ids: list[str]) -> DataFrame:
    """For each replicate and row the mask of `size` random cells: those with the smallest hashes."""
    each = df.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.struct(u(seed, "r", *ids, i).alias("draw"), i.alias("cell")))
    picked = F.transform(F.slice(F.array_sort(cells), F.lit(1), F.col(size).cast("int")), lambda x: x["cell"])
    return each.withColumn("drawn_mask", mask_of(picked))


def uniform_set_null(masks: DataFrame, observed: DataFrame, replicates: int, seed: int, ids: list[str]) -> DataFrame:
    """Mean similarity of random sets of the observed sizes, and the share of replicates at or above the observed (mean_jaccard)."""
    sized = masks.withColumn("size", F.bit_count("mask"))
    drawn = _drawn(sized, replicates, seed, "size", ids).select("r", F.col("drawn_mask").alias("mask"))
    null = between_item_similarity(drawn, ["r"])
    joined = null.select("r", F.col("mean_jaccard").alias("j")).crossJoin(F.broadcast(observed.select("mean_jaccard")))
    return joined.agg(F.avg("j").alias("null_mean"), F.max("mean_jaccard").alias("observed"), share(F.count_if(F.col("j") >= F.col("mean_jaccard") - 1e-12), F.count("*")).alias("p_value"))


def empties(coverage: DataFrame, empty_below: float = 5.0) -> DataFrame:
    """(image_id, empty_mask): the cells of each image without tissue."""
    return coverage.groupBy("image_id").agg(F.coalesce(F.bit_or(F.when(F.col("tissue_pct") < empty_below, bit("cell_idx"))), F.lit(0)).alias("empty_mask"))


def uniform_cell_null(masks: DataFrame, coverage: DataFrame, replicates: int, seed: int, ids: list[str], empty_below: float = 5.0) -> DataFrame:
    """Empty cells that as many random cells of the same image hit, per replicate, against those cited."""
    sized = masks.withColumn("size", F.bit_count("mask")).join(empties(coverage, empty_below), "image_id")
    drawn = _drawn(sized, replicates, seed, "size", ids)
    per = drawn.groupBy("r").agg(F.sum(F.bit_count(F.col("drawn_mask").bitwiseAND(F.col("empty_mask"))).cast("long")).alias("hit"), F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col("empty_mask"))).cast("long")).alias("cited"))
    return per.agg(F.max("cited").alias("observed"), F.avg("hit").alias("null_mean"), share(F.count_if(F.col("hit") <= F.col("cited")), F.count("*")).alias("p_value"))


def uniform_cell_expectation(masks: DataFrame, coverage: DataFrame, empty_below: float = 5.0) -> DataFrame:
    """The same null's mean in closed form: each cited cell is empty as often as the image's cells are."""
    e = masks.join(empties(coverage, empty_below), "image_id")
    return e.agg(F.sum(F.bit_count("mask") * F.bit_count("empty_mask") / F.lit(float(CELLS))).alias("null_mean"))


def shuffled_item_null(masks: DataFrame, coverage: DataFrame, replicates: int, seed: int, empty_below: float = 5.0, id_column: str = "image_id") -> DataFrame:
    """Empty cells hit when cell sets keep but items are permuted; one row of masks an item.

    A replicate's permutation joins the rank of items by id to their rank by hash (see ranks.with_ahead). Every replicate is a
    copy of the items; nulls.shuffled_items draws the same law from counts.
    """
    path = fresh_folder(masks.sparkSession, "items")
    masks.join(empties(coverage, empty_below), "image_id").select(id_column, "mask", "empty_mask").write.parquet(path)
    once = masks.sparkSession.read.parquet(path)
    items = once.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    plain = with_ahead(once, [], id_column, name="rank")
    a = plain.select("mask", "empty_mask", "rank").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    b = with_ahead(items.withColumn("draw", u(seed, "r", id_column)), ["r"], "draw", even=True, ties=(id_column,), name="rank").select("r", F.col("empty_mask").alias("other"), "rank")
    hit = lambda m: F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col(m))).cast("long"))
    per = a.join(b, ["r", "rank"]).groupBy("r").agg(hit("other").alias("hit"), hit("empty_mask").alias("cited"))
    return per.agg(F.max("cited").alias("observed"), F.avg("hit").alias("null_mean"), share(F.count_if(F.col("hit") <= F.col("cited")), F.count("*")).alias("p_value"))


def label_permutation(df: DataFrame, value: str, group: str, replicates: int, seed: int, row_key: str) -> DataFrame:
    """Difference of means of group over the rest, and the share of permutations at or above it."""
    totals = df.agg(F.count_if(group).alias("n_in"), (F.avg(F.when(F.col(group), F.col(value))) - F.avg(F.when(~F.col(group), F.col(value)))).alias("observed"))
    each = df.select(row_key, value).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    ranked = with_ahead(each.withColumn("draw", u(seed, "r", row_key)), ["r"], "draw", even=True, ties=(row_key,), name="rank")
    drawn = ranked.crossJoin(F.broadcast(totals))
    inside = F.col("rank") < F.col("n_in")
    diff = F.avg(F.when(inside, F.col(value))) - F.avg(F.when(~inside, F.col(value)))
    per = drawn.groupBy("r").agg(diff.alias("d"), F.max("observed").alias("observed"))
    return per.agg(F.max("observed").alias("observed"), F.avg("d").alias("null_mean"), share(F.count_if(F.col("d") >= F.col("observed")), F.count("*")).alias("p_value"))


def preference_expectation(frequency: DataFrame, coverage: DataFrame, empty_below: float = 5.0) -> DataFrame:
    """Expected empty share of cells drawn from pooled citation frequencies (cell, n_cited) in every image."""
    total = frequency.agg(F.sum("n_cited").alias("total"))
    p = frequency.crossJoin(F.broadcast(total)).select("cell", (F.col("n_cited") / F.col("total")).alias("p"))
    rate = coverage.groupBy("cell").agg(F.avg((F.col("tissue_pct") < empty_below).cast("double")).alias("empty"))
    return p.join(F.broadcast(rate), "cell").agg(F.sum(F.col("p") * F.col("empty")).alias("expected_empty_rate"))


def block_shuffle(blocks: DataFrame, seed: int, least_tissue: float = 0.3) -> DataFrame:
    """Blocks (image_id, block, masked, tissue_share): each block that holds mask gets a random slot with tissue.

    Surplus source blocks get none; `moved_from` and `moved_to` pair up by rank, and the lost ones are reported.
    """
    source = F.when(F.col("masked") > 0, F.struct(F.col("block").alias("moved_from"), "masked"))
    slot = F.when(F.col("tissue_share") > least_tissue, F.struct(u(seed, "image_id", "block").alias("draw"), F.col("block").alias("moved_to")))
    # an image's blocks meet as two short lists in one shuffle: no join, of which Spark might send a whole side through the driver
    each = blocks.groupBy("image_id").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.array_sort(F.collect_list(slot)).alias("slots"))
    moved = each.select("image_id", F.posexplode("sources").alias("rank", "source"), "slots").select("image_id", "source.*", F.get("slots", F.col("rank"))["moved_to"].alias("moved_to"))
    return moved.select("image_id", "moved_from", "moved_to", "masked", F.col("moved_to").isNull().alias("lost"))
