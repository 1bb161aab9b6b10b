"""Records of responses and calls: checks, deduplication, unions, resume and cache lookups, costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("HP", "SSA")


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_bad) from one pass over df; a rule's column is true for bad rows."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_bad")) for n in rules])
    return counts.select(F.inline(pairs))


def check_annotations(ann: DataFrame) -> DataFrame:
    """Null keys, labels, partitions and votes out of their domains, and keys that occur again."""
    rules = {
        "null_key": F.col("image_id").isNull(),
        "bad_label": ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)),
        "bad_partition": ~F.coalesce(F.col("partition").isin("train", "test"), F.lit(False)),
        "bad_votes": F.col("ssa_votes").isNull() | ~F.col("ssa_votes").between(0, 7),
    }
    again = ann.where(F.col("image_id").isNotNull()).groupBy("image_id").count()
    again = again.agg(F.count_if(F.col("count") > 1).alias("n_bad")).select(F.lit("duplicate_key").alias("rule"), "n_bad")
    return broken_rules(ann, rules).unionByName(again)


def check_runs(runs: DataFrame) -> DataFrame:
    """Confidences in [0, 1], votes in 0..7, prompts with a known prefix."""
    return broken_rules(runs, {
        "confidence_range": ~F.col("confidence").between(0.0, 1.0),
        "agreement_range": ~F.col("ssa_votes").between(0, 7),
        "prompt_prefix": ~F.col("prompt_id").rlike("^(co|cte|etc)_"),
    })


def check_predictions(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Label domain, confidence null or in [0, 1], model name not blank."""
    return broken_rules(df, {
        "bad_label": ~F.coalesce(F.col("label_pred").isin(*labels), F.lit(False)),
        "bad_confidence": F.col("confidence").isNotNull() & ~F.col("confidence").between(0.0, 1.0),
        "blank_model": F.trim(F.coalesce("model", F.lit(""))) == "",
    })


def agreement(ann: DataFrame) -> DataFrame:
    """The larger camp's votes, and the band that they make."""
    v = F.col("ssa_votes")
    band = F.when(v.isin(0, 7), "unanimous").when(v.isin(3, 4), "borderline").otherwise("strong")
    return ann.select("*", F.greatest(v, 7 - v).alias("agreement"), band.alias("agreement_band"))


def index_labels(df: DataFrame, label: str, order: tuple[str, ...], id_format: str, *id_columns: str) -> DataFrame:
    """A label's position in order, and an id made from columns."""
    position = reduce(lambda c, i: c.when(F.col(label) == order[i], i), range(1, len(order)), F.when(F.col(label) == order[0], 0))
    return df.select("*", position.cast("long").alias("label_index"), F.format_string(id_format, *id_columns).alias("sample_id"))


def dedup(df: DataFrame, key: list[str], keep: str = "first", seq: str = "seq") -> DataFrame:
    """The first or last row of each key by seq; rows combine before the shuffle."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    rest = [c for c in df.columns if c not in key]
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*key).agg(pick(F.struct(*rest), seq).alias("row")).select(*key, "row.*")


def union_runs(runs: dict[str, DataFrame], tag: str = "run") -> DataFrame:
    """All runs under one another, tagged; missing columns are null."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def with_truth(runs: DataFrame, truth: DataFrame, key: str = "image_id") -> DataFrame:
    """runs with their truth; strict_truth tells whether any key had none.

    A task holds its share of the truth, a row a key, and runs pass by; merging would have it sort all of its runs.
    """
    return runs.join(truth.hint("shuffle_hash"), key, "left")


def unmatched(joined: DataFrame, label: str = "label", key: str = "image_id") -> DataFrame:
    """How many rows and ids found no truth; callers stop when it isn't 0."""
    missing = F.col(label).isNull()
    return joined.agg(F.count_if(missing).alias("n_rows"), F.count_distinct(F.when(missing, F.col(key))).alias("n_ids"))


#: What counts as done when a job list is resumed.
DONE = {
    "any": lambda: F.lit(True),
    "no_error": lambda: ~F.col("failed"),
    "no_error_and_parsed": lambda: ~F.col("failed") & F.col("predicted_label").isNotNull(),
}


def pending(jobs: DataFrame, ledger: DataFrame, key: list[str], policy: str = "no_error") -> DataFrame:
    """The jobs that the ledger hasn't done."""
    return jobs.join(ledger.where(DONE[policy]()).select(*key).distinct(), key, "left_anti")


def cache_lookup(requests: DataFrame, cache: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """requests with status: written (already in the ledger), hit (in the cache) or miss."""
    seen = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    joined = requests.join(seen(cache, "cached"), key, "left").join(seen(written, "done"), key, "left")
    status = F.when(F.col("done"), "written").when(F.col("cached"), "hit").otherwise("miss")
    return joined.withColumn("status", status).drop("cached", "done")


def enumerate_jobs(items: DataFrame, dims: list[DataFrame], repeats: int = 1, again: Column | None = None) -> DataFrame:
    """Items times small dimensions; replicate 1 for all, 2 to repeats for the items for which again holds."""
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), dims, items)
    last = F.when(again, F.lit(repeats)).otherwise(1) if again is not None else F.lit(repeats)
    return out.withColumn("replicate", F.explode(F.sequence(F.lit(1), last)))


def quarantine(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failures): a failed or unparsed call is never counted as done."""
    bad = F.col("failed") | F.col("predicted_label").isNull()
    return calls.where(~bad), calls.where(bad)


def cost_ledger(calls: DataFrame, by: str, rate_in: float, rate_out: float, expected: int) -> DataFrame:
    """Tokens, cost and runtime of all calls, repeats included; ids with a valid label count once."""
    done = F.count_distinct(F.when(F.col("predicted_label").isin(*LABELS) & ~F.col("failed"), F.col("image_id")))
    tokens_in, tokens_out = F.sum("input_tokens"), F.sum("output_tokens")
    return calls.groupBy(by).agg(
        F.count("*").alias("calls"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        ((tokens_in * rate_in + tokens_out * rate_out) / F.lit(1e6)).alias("cost"), F.sum("latency_seconds").alias("runtime_seconds"),
        done.alias("completed"), (done / F.lit(float(expected))).alias("coverage"),
    )


def budget_projection(ledger: DataFrame, budget: float, full: float = 0.95) -> DataFrame:
    """Totals, what is left, the mean cost of full runs and how many more of them the rest affords."""
    mean_full = F.avg(F.when(F.col("coverage") >= full, F.col("cost")))
    out = ledger.agg(F.sum("calls").alias("calls"), F.sum("cost").alias("cost"), mean_full.alias("mean_full_cost"))
    left = F.lit(budget) - F.col("cost")
    return out.select("*", left.alias("remaining"), F.when(F.col("mean_full_cost") > 0, F.floor(F.greatest(left, F.lit(0.0)) / F.col("mean_full_cost"))).alias("affordable_runs"), (left < 0).alias("over_budget"))


def first_nonzero(*columns: str) -> Column:
    """The first of alternative fields that isn't null or zero."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0).cast("double")) for c in columns], F.lit(0.0))


def run_health(calls: DataFrame, by: str, gap: Column | None = None) -> DataFrame:
    """Records, scored ones, errors, answers without error that can't be parsed, and the mean of gap over scored records (0 of none)."""
    ok = F.col("predicted_label").isNotNull() & ~F.col("failed")
    return calls.groupBy(by).agg(
        F.count("*").alias("records"), F.count_if(ok).alias("scored"), F.count_if("failed").alias("errors"),
        F.count_if(~F.col("failed") & F.col("predicted_label").isNull()).alias("parse_failures"),
        *([F.coalesce(F.avg(F.when(ok, gap)), F.lit(0.0)).alias("mean_match_gap")] if gap is not None else []),
    )


def completion_audit(calls: DataFrame, by: str, expected: int) -> DataFrame:
    """Success rows, distinct ids, repeats, what remains; failures, and how many of their ids succeeded as well."""
    ok = F.col("predicted_label").isNotNull() & ~F.col("failed")
    per = calls.groupBy(by, "image_id").agg(F.count_if(ok).alias("s"), F.count_if(~ok).alias("f"))
    n, ids = F.sum("s"), F.count_if(F.col("s") > 0)
    return per.groupBy(by).agg(
        n.alias("success_rows"), ids.alias("unique_ids"), (n - ids).alias("duplicates"), (F.lit(expected) - ids).alias("remaining"),
        F.sum("f").alias("failures"), F.count_if((F.col("f") > 0) & (F.col("s") > 0)).alias("recovered_ids"),
    )
