"""Contrasts between arms, prompts and conditions of the same items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import jaccard_arrays, jaccard_masks, share, sign_test


def with_baseline(masked: DataFrame, runs: DataFrame, replicate: int | None = 1) -> DataFrame:
    """masked with the label and confidence of the item's baseline answer (the last parsed one by seq)."""
    from .ledger import dedup

    base = runs.where("label_pred IS NOT NULL")
    if replicate is not None:
        base = base.where(F.col("replicate") == replicate)
    base = dedup(base.select("image_id", "seq", "label_pred", "confidence"), ["image_id"], "last")
    return masked.join(base.select("image_id", F.col("label_pred").alias("base_label"), F.col("confidence").alias("base_confidence")), "image_id", "left")


def pair_arms(df: DataFrame, keys: list[str], arm: str, treat: str, ctrl: str, value: str = "flipped") -> DataFrame:
    """Per keys the last value of both arms by seq; incomplete pairs go. One grouping, no self join."""
    of = lambda a: F.max_by(F.when(F.col(arm) == a, F.col(value)), F.when((F.col(arm) == a) & F.col(value).isNotNull(), F.col("seq")))
    return df.groupBy(*keys).agg(of(treat).alias("treat"), of(ctrl).alias("ctrl")).where("treat IS NOT NULL AND ctrl IS NOT NULL")


def pair_conditions(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    """Items answered under both conditions; columns of a end in _a, of b in _b."""
    rename = lambda df, s: df.select(key, *[F.col(c).alias(c + s) for c in df.columns if c != key])
    return rename(a, "_a").join(rename(b, "_b"), key)


def common_items(runs: DataFrame, item: str, run: str, k: int) -> DataFrame:
    """Items that occur in all k runs."""
    return runs.groupBy(item).agg(F.count_distinct(run).alias("n_runs")).where(F.col("n_runs") == k).select(item)


def flipped(df: DataFrame) -> Column:
    """Whether an answer differs from its baseline; null without either."""
    return (F.col("label_pred") != F.col("base_label")).cast("int")


def arm_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Answers with a baseline: flips, their rate, and the mean change of confidence (null confidences count as 0)."""
    ok = df.where("label_pred IS NOT NULL AND base_label IS NOT NULL")
    flips = F.count_if(F.col("label_pred") != F.col("base_label"))
    change = F.abs(F.coalesce("confidence", F.lit(0.0)) - F.coalesce("base_confidence", F.lit(0.0)))
    return ok.groupBy(*keys).agg(
        F.count("*").alias("n"), flips.alias("flips"), share(flips, F.count("*")).alias("flip_rate"), F.avg(change).alias("mean_abs_dconf"),
        F.count_distinct(F.when(F.col("label_pred") != F.col("base_label"), F.col("image_id"))).alias("flipped_items"),
    )


def discordance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs in which both, one or no arm flipped, with the exact test."""
    t, c = F.col("treat") == 1, F.col("ctrl") == 1
    counts = pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.count_if(t & ~c).alias("treat_only"), F.count_if(~t & c).alias("ctrl_only"), F.count_if(t & c).alias("both"), F.count_if(~t & ~c).alias("neither")
    )
    return counts.withColumn("p_value", sign_test("treat_only", "ctrl_only"))


def pooled_discordance(pairs: DataFrame, by: str) -> DataFrame:
    """The same by stratum and, with a null stratum, over all."""
    t, c = F.col("treat") == 1, F.col("ctrl") == 1
    counts = pairs.rollup(by).agg(F.count("*").alias("pairs"), F.count_if(t & ~c).alias("treat_only"), F.count_if(~t & c).alias("ctrl_only"))
    return counts.withColumn("p_value", sign_test("treat_only", "ctrl_only"))


def structure_summary(df: DataFrame) -> DataFrame:
    """arm_summary by source and arm, with the share of tissue that each arm masks."""
    pct = F.when(F.col("arm") == "treatment", F.col("struct_tissue_pct")).otherwise(F.col("control_tissue_pct"))
    base = arm_summary(df, ["source", "arm"])
    return base.join(df.where("label_pred IS NOT NULL AND base_label IS NOT NULL").groupBy("source", "arm").agg(F.avg(pct).alias("mean_masked_pct")), ["source", "arm"])


def named_split(df: DataFrame) -> DataFrame:
    """Flip rate of the treatment by source and by whether the source was named; absent groups have no row."""
    ok = df.where("label_pred IS NOT NULL AND base_label IS NOT NULL AND arm = 'treatment'")
    flips = F.count_if(F.col("label_pred") != F.col("base_label"))
    return ok.groupBy("source", "named").agg(F.count("*").alias("n"), flips.alias("flips"), share(flips, F.count("*")).alias("flip_rate"))


def paraphrase_summary(runs: DataFrame, design: DataFrame, positive: str = "SSA") -> DataFrame:
    """Every prompt of the design: answers, right ones, positives, mean confidence; prompts without a run are marked."""
    found = runs.where("label_pred IS NOT NULL").groupBy("prompt_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("label_pred") == F.col("label")).alias("correct"), F.count_if(F.col("label_pred") == positive).alias("positives"),
        F.avg(F.coalesce("confidence", F.lit(0.0))).alias("mean_confidence"),
    )
    out = design.join(found, "prompt_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("prompt_id", zero("n"), zero("correct"), zero("positives"), "mean_confidence", F.col("n").isNull().alias("missing"))


def directional_flips(runs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Changes of label from condition a to b, per direction, with the exact test."""
    of = lambda c: F.max_by(F.when(F.col("condition") == c, F.col("label_pred")), F.when((F.col("condition") == c) & F.col("label_pred").isNotNull(), F.col("seq")))
    both = runs.groupBy("image_id", *by).agg(of(a).alias("a"), of(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    counts = both.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(F.expr("a = 'HP' AND b = 'SSA'")).alias("hp_to_ssa"), F.count_if(F.expr("a = 'SSA' AND b = 'HP'")).alias("ssa_to_hp"))
    return counts.withColumn("p_value", sign_test("hp_to_ssa", "ssa_to_hp"))


def wording_unanimity(runs: DataFrame, prompts: int) -> DataFrame:
    """Items answered under all prompts, and those with one label under all of them."""
    per = runs.where("label_pred IS NOT NULL").groupBy("image_id").agg(F.count_distinct("prompt_id").alias("p"), F.count_distinct("label_pred").alias("l"))
    return per.where(F.col("p") == prompts).agg(F.count("*").alias("shared_items"), F.count_if(F.expr("l = 1")).alias("unanimous"))


def condition_similarity(pairs: DataFrame) -> DataFrame:
    """Means over paired items of cell, feature and token similarity, and label agreement."""
    both = F.col("label_a").isNotNull() & F.col("label_b").isNotNull()
    return pairs.agg(
        F.count("*").alias("items"), F.avg(jaccard_masks("mask_a", "mask_b")).alias("cell_jaccard"), F.avg(jaccard_arrays("features_a", "features_b")).alias("feature_jaccard"),
        F.avg(jaccard_arrays("tokens_a", "tokens_b")).alias("token_jaccard"), share(F.count_if(both & (F.col("label_a") == F.col("label_b"))), F.count_if(both)).alias("label_agreement"),
    )


def similarity_position(floor: DataFrame, ceiling: DataFrame, cross: DataFrame) -> DataFrame:
    """Where the cross-condition similarity lies between floor (other items) and ceiling (replicates); one row each."""
    one = floor.crossJoin(F.broadcast(ceiling)).crossJoin(F.broadcast(cross))
    place = F.when(F.col("ceiling") > F.col("floor"), (F.col("cross") - F.col("floor")) / (F.col("ceiling") - F.col("floor")))
    return one.select("floor", "ceiling", "cross", place.alias("position"))


def feature_usage(items: DataFrame, by: list[str]) -> DataFrame:
    return items.groupBy(*by, "feature").agg(F.count("*").alias("n"))


def faithfulness(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean drop of confidence, flips, comprehensiveness, sufficiency, and the drop beyond the control's."""
    drop = F.col("orig_conf") - F.col("new_conf")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(drop).alias("comprehensiveness"), F.avg(F.col("orig_conf") - F.col("sufficiency_conf")).alias("sufficiency"),
        F.avg(drop - (F.col("orig_conf") - F.col("control_conf"))).alias("net_drop"), share(F.count_if(F.col("orig_label") != F.col("new_label")), F.count("*")).alias("flip_rate"),
    )


def centrality_corr(frequency: DataFrame) -> DataFrame:
    """Correlation of citation counts (cell, n_cited, n_available) with being an inner cell and with availability."""
    inner = F.when(F.col("cell").rlike("^[BC][23]$"), 1.0).otherwise(0.0)
    return frequency.agg(F.corr("n_cited", inner).alias("with_centrality"), F.corr("n_cited", "n_available").alias("with_availability"))
