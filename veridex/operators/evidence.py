"""Cited cells: sets of cells as masks, coverage joins, validity, stability and similarity of citations."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import CELLS, bit, cell_name, cells_of, jaccard_masks, share

RESPONSE = ["image_id", "prompt_id", "replicate"]


def cell_geometry(spark: SparkSession, cell_px: int = 56) -> DataFrame:
    """The 16 cells: name, row, column, pixel box, whether it touches the tile's border, and the transposed cell."""
    i = F.col("cell_idx")
    r, c = (i / 4).cast("int"), (i % 4).cast("int")
    border = (r == 0) | (r == 3) | (c == 0) | (c == 3)
    return spark.range(CELLS).select(F.col("id").cast("int").alias("cell_idx")).select(
        "cell_idx", cell_name(i).alias("cell"), r.alias("row"), c.alias("col"), (c * cell_px).alias("x0"), (r * cell_px).alias("y0"),
        ((c + 1) * cell_px).alias("x1"), ((r + 1) * cell_px).alias("y1"), border.alias("touches_border"), (c * 4 + r).alias("transposed_idx"),
    )


def cited_cells(citations: DataFrame, keys: list[str] = RESPONSE) -> DataFrame:
    """The distinct cells of each response, ascending, and their mask."""
    return citations.groupBy(*keys).agg(F.bit_or(bit("cell_idx")).alias("mask")).withColumn("cells", cells_of("mask"))


def citation_pairs(responses: DataFrame, evidence: str = "evidence") -> DataFrame:
    """(keys, feature, cell) of nested evidence (feature, grid_cells_valid), repeats kept."""
    items = responses.select(*[c for c in responses.columns if c != evidence], F.explode(evidence).alias("item"))
    return items.select(*[c for c in items.columns if c != "item"], F.col("item.feature").alias("feature"), F.explode("item.grid_cells_valid").alias("cell"))


def evidence_items(responses: DataFrame, features: list[str], evidence: str = "evidence") -> DataFrame:
    """One row an item, numbered, whose feature is known, with cells and a description that isn't blank."""
    keep = [c for c in responses.columns if c != evidence]
    items = responses.select(*keep, F.posexplode(evidence).alias("item_no", "item"))
    good = F.col("item.feature").isin(features) & (F.size("item.grid_cells_valid") > 0) & (F.trim(F.coalesce("item.description", F.lit(""))) != "")
    return items.where(good).select(*keep, "item_no", "item.feature", F.col("item.grid_cells_valid").alias("cells"), "item.description")


def nested(citations: DataFrame, keys: list[str] = RESPONSE) -> DataFrame:
    """Citations as responses with nested evidence, for operators that read answers. Citations are shuffled once, by response."""
    cited = citations.select(*keys, "item", "feature", "cell_idx").repartition(*keys).select(*keys, F.struct("item", "feature", "cell_idx", cell_name("cell_idx").alias("cell")).alias("_c"))
    each = cited.groupBy(*keys).agg(F.sort_array(F.collect_list("_c")).alias("_c"))
    named = lambda x: F.struct(x["item"].alias("item"), x["feature"].alias("feature"))
    within = lambda x, i: x["item"].eqNullSafe(i["item"]) & x["feature"].eqNullSafe(i["feature"]) & x["cell"].isNotNull()
    cells = lambda i: F.transform(F.filter("_c", lambda x: within(x, i)), lambda x: x["cell"])
    item = lambda i: F.struct(i["item"].alias("item"), i["feature"].alias("feature"), cells(i).alias("grid_cells_valid"), F.concat_ws(" ", F.lit("seen in"), i["feature"]).alias("description"))
    return each.select(*keys, F.transform(F.array_distinct(F.transform("_c", named)), item).alias("evidence"))


def parse_cells(text: Column | str) -> tuple[Column, Column]:
    """(valid names, invalid ones) of a list with commas or semicolons: upper case, trimmed, distinct, in order."""
    names = F.array_distinct(F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    known = lambda x: x.rlike("^[A-D][1-4]$")
    return F.filter(names, known), F.filter(names, lambda x: ~known(x))


def with_coverage(citations: DataFrame, coverage: DataFrame) -> DataFrame:
    """Citations with the tissue of their cell."""
    return citations.join(coverage.select("image_id", "cell_idx", "cell", "tissue_pct"), ["image_id", "cell_idx"])


def empty_citations(citations: DataFrame, coverage: DataFrame, by: list[str], empty_below: float = 5.0) -> DataFrame:
    """How many distinct cited cells have no tissue, with the rate of cells drawn uniformly in the same images."""
    keys = list(dict.fromkeys([*RESPONSE, *by]))
    masks = citations.groupBy(*keys).agg(F.bit_or(bit("cell_idx")).alias("mask"))
    # one row an image with the tissue of its 16 cells, so citations meet it once; counts go by bits
    empty, cell = F.col("tissue_pct") < empty_below, F.col("cell_idx")
    known, none = (F.coalesce(F.bit_or(F.when(c, bit("cell_idx"))), F.lit(0)) for c in (F.col("tissue_pct").isNotNull(), empty))
    tissue = [F.max(F.when(cell == i, F.col("tissue_pct"))).alias(f"t{i}") for i in range(CELLS)]
    tiles = coverage.groupBy("image_id").agg((F.count_if(empty) / F.count("*")).alias("uniform"), known.alias("known"), none.alias("none"), *tissue)
    tiles = tiles.select("image_id", "uniform", "known", "none", F.array(*[f"t{i}" for i in range(CELLS)]).alias("tissue"))
    per = masks.join(tiles, "image_id").withColumn("mask", F.col("mask").bitwiseAND(F.col("known"))).where("mask <> 0")
    values = F.transform(cells_of("mask"), lambda c: F.element_at("tissue", c + 1))
    size = F.bit_count("mask").cast("long")
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / size
    per = per.select(*keys, "uniform", size.alias("n"), F.bit_count(F.col("mask").bitwiseAND(F.col("none"))).cast("long").alias("e"), F.array_min(values).alias("low"), mean.alias("mean"))
    n, e = F.sum("n"), F.sum("e")
    return per.groupBy(*by).agg(
        F.count("*").alias("responses"), n.alias("n_cited"), e.alias("n_empty"), share(e, n).alias("empty_rate"),
        (F.sum(F.col("n") * F.col("uniform")) / n).alias("uniform_rate"), F.min("low").alias("min_tissue"), F.avg("mean").alias("mean_tissue"),
    )


def empty_by_feature(citations: DataFrame, coverage: DataFrame, empty_below: float = 5.0) -> DataFrame:
    """Citations of each feature and how many fall on cells whose rounded coverage is empty."""
    joined = with_coverage(citations, coverage)
    return joined.groupBy("feature").agg(F.count("*").alias("n_cited"), F.count_if(F.round("tissue_pct", 1) < empty_below).alias("n_empty"))


def validity_summary(responses: DataFrame) -> DataFrame:
    """Totals over responses (n_valid, n_invalid, parsed): parsed ones, citations and the invalid share."""
    valid, bad = F.sum("n_valid"), F.sum("n_invalid")
    return responses.agg(
        F.count("*").alias("responses"), F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("parse_failures"), valid.alias("valid_citations"),
        bad.alias("invalid_citations"), share(bad, valid + bad).alias("invalid_rate"), F.count_if(F.col("n_invalid") > 0).alias("responses_with_invalid"),
    )


def violation_kinds(df: DataFrame, violations: str = "violations", k: int = 10) -> DataFrame:
    """The most common kinds: text before the first space and bracket; ties by name."""
    kinds = df.select(F.explode(violations).alias("v")).select(F.substring_index(F.substring_index("v", " ", 1), "[", 1).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(k)


def cell_frequency(citations: DataFrame, coverage: DataFrame, empty_below: float = 5.0) -> DataFrame:
    """All 16 cells: responses that cite each, citations per response, and tiles in which the cell has tissue."""
    cited = citations.select(*RESPONSE, "cell_idx").distinct()
    total = cited.select(*RESPONSE).distinct().agg(F.count("*").alias("responses"))
    n = cited.groupBy("cell_idx").agg(F.count("*").alias("n_cited"))
    tissue = coverage.groupBy("cell_idx").agg(F.count_if(F.col("tissue_pct") >= empty_below).alias("n_available"))
    cells = cell_geometry(citations.sparkSession).select("cell_idx", "cell")
    out = cells.join(n, "cell_idx", "left").join(tissue, "cell_idx", "left").crossJoin(F.broadcast(total))
    cited_n = F.coalesce("n_cited", F.lit(0))
    return out.select("cell", cited_n.alias("n_cited"), F.coalesce("n_available", F.lit(0)).alias("n_available"), share(cited_n, F.col("responses")).alias("cited_share"))


def transposition(citations: DataFrame, coverage: DataFrame, empty_below: float = 5.0) -> DataFrame:
    """Tissue of cited cells as named and with rows and columns swapped."""
    i = F.col("cell_idx")
    cited = citations.select(*RESPONSE, "cell_idx").distinct().withColumn("swapped", (i % 4) * 4 + (i / 4).cast("int"))
    tissue = coverage.select("image_id", "cell_idx", F.col("tissue_pct").alias("as_is"))
    other = coverage.select("image_id", F.col("cell_idx").alias("swapped"), F.col("tissue_pct").alias("turned"))
    both = cited.join(tissue, ["image_id", "cell_idx"]).join(other, ["image_id", "swapped"])
    off = i != F.col("swapped")
    return both.agg(
        F.count("*").alias("n_cited"), F.count_if(~off).alias("on_diagonal"), F.count_if(off & (F.col("as_is") > F.col("turned"))).alias("as_is_better"),
        F.count_if(off & (F.col("as_is") < F.col("turned"))).alias("turned_better"), F.avg("as_is").alias("mean_as_is"), F.avg("turned").alias("mean_turned"),
        F.count_if((F.col("as_is") < empty_below) & (F.col("turned") >= empty_below)).alias("rescued"),
    )


def replicate_pairs(masks: DataFrame, group: list[str], rank: str = "replicate") -> DataFrame:
    """Unordered pairs of replicates of one group, a row each (Spark splits the join of a large group; totals alone need no
    pairs, see replicate_stability)."""
    a = masks.select(*group, F.col(rank).alias("rank_a"), F.col("mask").alias("mask_a"))
    b = masks.select(*group, F.col(rank).alias("rank_b"), F.col("mask").alias("mask_b"))
    return a.join(b, group).where("rank_a < rank_b").withColumn("jaccard", jaccard_masks("mask_a", "mask_b"))


#: Groups with more different masks are worked out by sums over supersets, others pair by pair.
FEW_MASKS = 64


def _stability(masks: DataFrame, group: list[str], keep_single: bool) -> DataFrame:
    counted = masks.groupBy(*group, "mask").agg(F.count("*").alias("n"))
    g = counted.groupBy(*group).agg(F.sum("n").alias("n_reps"), F.array_sort(F.collect_list(F.struct("mask", "n"))).alias("held"))
    if not keep_single:
        g = g.where("n_reps >= 2")
    few, size = F.size("held") <= FEW_MASKS, F.size("held")
    times = lambda a, b: (a["n"] * b["n"]).cast("double") * jaccard_masks(a["mask"], b["mask"])
    unlike = F.flatten(F.transform("held", lambda a, i: F.transform(F.slice("held", i + 2, size), lambda b: times(a, b))))
    alike = F.aggregate("held", F.lit(0.0), lambda s, a: s + a["n"] * (a["n"] - 1) / 2)
    all_pairs = F.greatest(F.col("n_reps") * (F.col("n_reps") - 1) / 2, F.lit(1.0))
    small = g.where(few).withColumn("mean_jaccard", (F.aggregate(unlike, F.lit(0.0), lambda s, x: s + x) + alike) / all_pairs)
    large = g.where(~few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = []
            for held in batch.column("held"):
                counts = np.zeros(1 << CELLS)
                counts[held.values.field("mask").to_numpy()] = held.values.field("n").to_numpy()
                means.append(pair_similarity(counts)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(means, pa.float64())], names=[*batch.schema.names, "mean_jaccard"])

    both = small.unionByName(large.mapInArrow(run, T.StructType([*large.schema.fields, T.StructField("mean_jaccard", T.DoubleType())])))
    cells = F.array(*[F.lit(c) for c in range(CELLS)])
    of = lambda c: F.aggregate("held", F.lit(0).cast("long"), lambda s, a: s + F.when(a["mask"].bitwiseAND(bit(c)) != 0, a["n"]).otherwise(0))
    cited = F.transform(cells, of)
    found = both.withColumn("cited", cited)
    exactly = lambda n: F.size(F.filter("cited", lambda k: k == n)).cast("long")
    return found.select(
        *group, "n_reps", "mean_jaccard", exactly(F.col("n_reps")).alias("cells_in_all"), exactly(F.lit(1)).alias("cells_in_one"),
        (F.aggregate("cited", F.lit(0).cast("long"), lambda s, k: s + k) / F.col("n_reps").cast("double")).alias("mean_cells"), F.size(F.filter("cited", lambda k: k > 0)).alias("union_cells"),
    )


def replicate_stability(masks: DataFrame, group: list[str], keep_single: bool = False) -> DataFrame:
    """Per group: replicates, mean pairwise similarity, cells in every and in exactly one replicate.

    Replicates count by their masks, of which 16 cells allow 65,536: so a group is a bounded row, however many replicates it has.
    Groups of one replicate go unless keep_single, where their similarity is 0.
    """
    return _stability(masks, group, keep_single).drop("union_cells")


def response_history(responses: DataFrame, group: list[str]) -> DataFrame:
    """Per group the labels and confidences of its labelled responses in the order of replicates, and whether all labels agree."""
    ok = responses.where("label_pred IS NOT NULL").withColumn("at", F.struct("replicate", "seq"))
    out = ordered_history(ok, group, "at", "label_pred", "confidence")
    labels = F.col("label_pred")
    return out.select(*group, F.size(labels).cast("long").alias("n_reps"), labels.alias("labels"), F.col("confidence").alias("confidences"), (F.size(F.array_distinct(labels)) == 1).alias("label_stable"))


def stability_probe(masks: DataFrame, group: list[str]) -> DataFrame:
    """Over all groups, single and empty ones too: mean similarity by group and over all pairs, mean cells, and the core's share
    of all cited cells."""
    j = _stability(masks, group, keep_single=True)
    pairs = F.col("n_reps") * (F.col("n_reps") - 1) / 2
    pooled = F.sum(F.col("mean_jaccard") * pairs) / F.greatest(F.sum(pairs), F.lit(1.0))
    return j.agg(F.count("*").alias("groups"), F.avg("mean_jaccard").alias("mean_jaccard"), pooled.alias("pair_jaccard"), F.avg("mean_cells").alias("mean_cells"), share(F.sum("cells_in_all"), F.sum("union_cells")).alias("core_share"))


#: Number of cells of each mask.
POPCOUNT = np.array([i.bit_count() for i in range(1 << CELLS)])
_BINOMIAL = np.array([[comb(j, i) * (-1) ** (j - i) if j >= i else 0 for j in range(CELLS + 1)] for i in range(CELLS + 1)], dtype=np.float64)


def pair_similarity(counts: np.ndarray) -> tuple[float, float | None]:
    """Number of pairs, and their mean similarity, of sets that occur counts[mask] times.

    For each size the counts are added up over supersets; products of these sums count, for each pair of sizes, the sets of j
    cells that both of a pair hold, from which the pairs by cells in common follow by inversion.
    """
    n = float(counts.sum())
    pairs = n * (n - 1) / 2
    if not pairs:
        return pairs, None
    held = np.unique(POPCOUNT[counts > 0])
    above = np.where(POPCOUNT == held[:, None], counts, 0.0)
    for c in range(CELLS):
        halves = above.reshape(len(held), -1, 2, 1 << c)
        halves[:, :, 0] += halves[:, :, 1]
    common = np.stack([above[:, POPCOUNT == j] @ above[:, POPCOUNT == j].T for j in range(CELLS + 1)])
    by_common = np.tensordot(_BINOMIAL, common, axes=1)  # ordered pairs, each set with itself too
    total = 0.0
    for x, a in enumerate(held.tolist()):
        by_common[a, x, x] -= counts[POPCOUNT == a].sum()
        for y, b in enumerate(held.tolist()):
            for i in range(min(a, b) + 1):
                total += by_common[i, x, y] / 2 * (i / (a + b - i) if a + b else 1.0)
    return pairs, total / pairs


def between_item_similarity(masks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean similarity over all pairs of rows, from the counts of distinct masks.

    At most 2^16 masks exist, so a group has at most so many rows when it is worked out, whatever its number of items.
    """
    by = by or []
    counted = masks.groupBy(*by, "mask").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << CELLS)
        counts[pdf["mask"].to_numpy()] = pdf["n"].to_numpy()
        pairs, mean = pair_similarity(counts)
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in by}, "n_pairs": [pairs], "mean_jaccard": [mean]}).astype({"mean_jaccard": "float64"})

    schema = counted.select(*by).schema.add("n_pairs", "double").add("mean_jaccard", "double")
    out = counted.groupBy(*by).applyInPandas(run, schema)
    return out.withColumn("mean_jaccard", F.when(~F.isnan("mean_jaccard"), F.col("mean_jaccard")))


def top_k_cells(citations: DataFrame, coverage: DataFrame, k: int, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The k cited cells with most tissue; ties by name."""
    cited = with_coverage(citations.select(*keys, "cell_idx").distinct(), coverage)
    w = Window.partitionBy(*keys).orderBy(F.desc("tissue_pct"), "cell")
    return cited.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def flagged_panel(citations: DataFrame, coverage: DataFrame, empty_below: float = 5.0) -> DataFrame:
    """Per image: cited cells, those without tissue, and a verdict."""
    cited = with_coverage(citations.select("image_id", "cell_idx").distinct(), coverage)
    names = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    empty = F.when(F.col("tissue_pct") < empty_below, F.col("cell"))
    out = cited.groupBy("image_id").agg(names("cell").alias("cited"), names(empty).alias("on_empty"), F.count_if(F.col("tissue_pct") < empty_below).alias("n_empty"))
    return out.withColumn("verdict", F.when(F.col("n_empty") > 0, "cites empty").otherwise("ok"))


def ordered_history(df: DataFrame, key: list[str], order: str, *columns: str) -> DataFrame:
    """Per key the columns as arrays in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(*key).agg(rows.alias("h")).select(*key, *[F.col(f"h.{c}").alias(c) for c in (order, *columns)])


