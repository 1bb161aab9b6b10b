"""Classification and calibration metrics, exact and from grouped counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import incomplete_beta, share
from ..functions.digests import Texts
from ..functions.draws import binomial, generator, share_of
from ..sources.shared import fresh_folder
from .ranks import with_ahead


def classification_summary(df: DataFrame, by: list[str], truth: str = "label", predicted: str = "label_pred") -> DataFrame:
    """Rows with a known label: accuracy, distributions, and mean confidence (null counts as 0)."""
    ok = df.where(F.col(predicted).isNotNull())
    right = F.count_if(F.col(truth) == F.col(predicted))
    return ok.groupBy(*by).agg(
        F.count("*").alias("n"), right.alias("k"), share(right, F.count("*")).alias("accuracy"), F.count_if(F.col(predicted) == "SSA").alias("predicted_ssa"),
        F.count_if(F.col(truth) == "SSA").alias("true_ssa"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("mean_confidence"),
    )


def binary_metrics(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None, positive: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1; nothing of nothing is 0. Without positive, the larger of exactly two labels."""
    # rows shrink to counts of pairs of labels once, so what df is made of is worked out once too
    pairs, path = df.groupBy(*(by or []), truth, predicted).agg(F.count("*").alias("n")), fresh_folder(df.sparkSession, "pairs")
    if positive is None:
        pairs.write.parquet(path)
        pairs = df.sparkSession.read.parquet(path)
        known = pairs.select(F.col(truth).alias("x")).union(pairs.select(predicted)).where("x IS NOT NULL")
        labels = sorted(r[0] for r in known.distinct().limit(3).collect())
        if len(labels) != 2:
            raise ValueError(f"positive is needed: there are labels {labels}")
        positive = labels[1]
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    rows = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    counts = pairs.groupBy(*(by or [])).agg(rows(t & p).alias("tp"), rows(~t & p).alias("fp"), rows(t & ~p).alias("fn"), rows(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _score_counts(df: DataFrame, score: str, positive: Column, by: list[str], weight: Column | None = None) -> DataFrame:
    w = weight if weight is not None else F.lit(1)
    return df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(positive, w).otherwise(0)).alias("p"), F.sum(F.when(positive, 0).otherwise(w)).alias("q"))


def midranks(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """(by, s, n, midrank): ranks with ties, from distinct scores."""
    c = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"))
    return with_ahead(c, by, "s", "n").select(*by, "s", "n", (F.col("ahead") + (F.col("n") + 1) / F.lit(2.0)).alias("midrank"))


def roc_auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Exact area under the curve, ties half; null where one class is missing.

    Rows shrink to distinct scores first; each then wins against the negatives with lower scores, which are added up
    by ranges of scores (see ranks.with_ahead), so no window holds all scores.
    """
    by = by or []
    below = with_ahead(_score_counts(df, score, positive, by, weight), by, "s", "q", name="below")
    pairs = F.sum("p") * F.sum("q")
    wins = F.sum(F.col("p") * (F.col("below") + F.col("q") / F.lit(2.0)))
    return below.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def log_loss(df: DataFrame, p_true: Column, by: list[str] | None = None) -> DataFrame:
    """Mean cross entropy of the probability that the true class was given (at least 1e-15)."""
    return df.groupBy(*(by or [])).agg(F.avg(-F.ln(F.greatest(p_true, F.lit(1e-15)))).alias("log_loss"), F.count("*").alias("n"))


def softmax_loss(logits: str, label_index: str) -> Column:
    """Cross entropy of a row of logits, by log-sum-exp."""
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) - F.element_at(logits, F.col(label_index) + 1)


def bin_of(confidence: Column, n_bins: int) -> Column:
    """The bin by its edges i * (1 / n), which aren't the multiples that one expects; the last bin is closed."""
    step = 1.0 / n_bins
    edges = F.array(*[F.lit(i * step) for i in range(1, n_bins)])
    return F.size(F.filter(edges, lambda e: e <= confidence)).cast("long")


def reliability_curve(df: DataFrame, n_bins: int = 10, right: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Every bin with its bounds, rows, mean confidence and accuracy (null when empty)."""
    by = by or []
    right = right if right is not None else F.col("label") == F.col("label_pred")
    spark, step = df.sparkSession, 1.0 / n_bins
    bins = spark.range(n_bins).select(F.col("id").alias("bin"), (F.col("id") * step).alias("low"), ((F.col("id") + 1) * step).alias("high"))
    if by:
        bins = df.select(*by).distinct().crossJoin(F.broadcast(bins))
    found = df.groupBy(*by, bin_of(F.col("confidence"), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg(right.cast("double")).alias("accuracy"))
    return bins.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(df: DataFrame, n_bins: int = 10, right: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error: sum over bins of count / n * |accuracy - confidence|; null if a confidence is out of range."""
    by = by or []
    right = right if right is not None else F.col("label") == F.col("label_pred")
    bad = F.count_if(~F.col("confidence").between(0.0, 1.0))
    bins = df.groupBy(*by, bin_of(F.col("confidence"), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(right.cast("double")).alias("r"), bad.alias("bad"))
    value = F.sum(F.abs(F.col("r") - F.col("c"))) / F.sum("n")
    return bins.groupBy(*by).agg(F.when(F.sum("bad") == 0, value).alias("ece"), F.sum("n").alias("n"))


def confidence_audit(runs: DataFrame, truth: DataFrame, threshold: float = 0.1, least: int = 30, by: list[str] | None = None) -> DataFrame:
    """Calibration of first answers: usable with `least` rows, calibrated with an error of at most threshold."""
    from .ledger import dedup

    by = by or []
    first = dedup(runs, ["image_id", *by], "first").join(truth.select("image_id", "label"), "image_id").where("label_pred IS NOT NULL")
    out = ece(first, by=by)
    usable = F.col("n") >= least
    return out.select(*by, "n", F.when(usable, F.col("ece")).alias("ece"), usable.alias("usable"), (usable & (F.col("ece") <= threshold)).alias("calibrated"))


#: Least draws (of 32 bits) at which a row has the weights 1, 2, ... under Poisson(1).
POISSON = [math.ceil(x * 2**32) for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)]
#: Rows and replicates that are drawn at once.
DRAWN_ROWS, DRAWN_REPLICATES = 512, 64


def poisson_weights(keys: pa.Array, seed: int, replicates: int) -> np.ndarray:
    """Weights of rows (columns) in replicates (rows), as columns.u draws them from (seed, replicate, key) for keys after a "|"."""
    out, starts = np.zeros((replicates, len(keys)), dtype=np.uint8), [f"{seed}|{b}".encode() for b in range(replicates)]
    for room in sorted({len(x) for x in starts}):
        texts, which = Texts(keys, room), [b for b in range(replicates) if len(starts[b]) == room]
        for i in range(0, len(which), DRAWN_REPLICATES):
            some = which[i : i + DRAWN_REPLICATES]
            heads = texts.heads([starts[b] for b in some])
            for x in POISSON:
                out[some[0] : some[-1] + 1] += heads >= x
    return out


def _changes(s: pa.Array) -> np.ndarray:
    """Where the values of a sorted array begin."""
    other = pc.not_equal(s.slice(1), s.slice(0, len(s) - 1)).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(s.type):
        nan = np.isnan(s.to_numpy(zero_copy_only=False))
        other = other & ~(nan[1:] & nan[:-1])
    return np.r_[0, np.flatnonzero(other) + 1]


class _Wins:
    """Counts and wins of rows by score, of sorted blocks of rows.

    The first and the last score may go on in other tasks, so their counts are given as they are; of those between a task knows all rows.
    """

    def __init__(self, replicates: int):
        self.ends, self.middle = [], None  # (score, positives, negatives)
        self.p, self.q, self.wins = (np.zeros(replicates, dtype=np.int64) for _ in range(3))

    def add(self, scores: list, p: np.ndarray, q: np.ndarray) -> None:
        """Rising scores, with weights of positives and negatives (replicates x scores)."""
        if self.ends and (scores[0] == self.ends[-1][0] or (scores[0] != scores[0] and self.ends[-1][0] != self.ends[-1][0])):
            s, p0, q0 = self.ends.pop()
            p[:, 0] += p0
            q[:, 0] += q0
            scores = [s, *scores[1:]]
        if not self.ends:
            self.ends.append((scores[0], p[:, 0].copy(), q[:, 0].copy()))
            scores, p, q = scores[1:], p[:, 1:], q[:, 1:]
        elif len(self.ends) == 2:
            s, p0, q0 = self.ends.pop()
            scores, p, q = [s, *scores], np.c_[p0, p], np.c_[q0, q]
        if not scores:
            return
        self.ends.append((scores[-1], p[:, -1].copy(), q[:, -1].copy()))
        if len(scores) > 1:
            self.middle = scores[0] if self.middle is None else self.middle
            p, q = p[:, :-1], q[:, :-1]
            ahead = np.cumsum(q, axis=1) - q + self.q[:, None]
            self.wins += (p * (2 * ahead + q)).sum(axis=1)
            self.p += p.sum(axis=1)
            self.q += q.sum(axis=1)

    def rows(self, kind: pa.DataType):
        """(b, s, p, q, more): wins are p * (negatives before + q / 2) + more."""
        inner = [(self.middle, self.p, self.q, (self.wins - self.p * self.q) / 2)] if self.middle is not None else []
        for s, p, q, more in [*((s, p, q, np.zeros(len(p))) for s, p, q in self.ends), *inner]:
            b = np.flatnonzero(p + q)
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array([s] * len(b), type=kind), *(pa.array(x[b]) for x in (p, q, more))], names=["b", "s", "p", "q", "more"])


def bootstrap_auc(df: DataFrame, score: str, positive: Column, replicates: int, seed: int = 42, ci: float = 0.95, row_key: str = "row_key") -> DataFrame:
    """Percentile interval of the AUC under the Poisson bootstrap, whose weights seed, replicate and row decide.

    A row's weight in a replicate is Poisson(1); this differs from drawing n rows by O(1 / sqrt n). Rows are dealt out by ranges of score
    and key; a task draws its rows' weights by blocks, for all replicates, and gives three rows a replicate: its first and last score,
    which it may share, and what lies between. So rows are never repeated, and no task holds more than a block of them.
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), F.coalesce(positive, F.lit(False)).alias("t"), F.concat_ws("|", F.lit(""), F.col(row_key).cast("string")).alias("key"))
    if isinstance(rows.schema["s"].dataType, T.FractionalType) and not isinstance(rows.schema["s"].dataType, T.DecimalType):
        rows = rows.withColumn("s", F.col("s") + F.lit(0.0).cast(rows.schema["s"].dataType))  # -0.0 is 0.0
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def drawn_by_md5(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins, kind = _Wins(replicates), None
        for batch in batches:
            for i in range(0, batch.num_rows, DRAWN_ROWS):
                s, t, key = batch.slice(i, DRAWN_ROWS).columns
                kind, keys, at = s.type, pc.dictionary_encode(key), _changes(s)
                w = poisson_weights(keys.dictionary, seed, replicates)
                w = w if len(keys.dictionary) == len(key) else w[:, keys.indices.to_numpy()]
                both, p = (np.add.reduceat(x, at, axis=1, dtype=np.int64) for x in (w, w * t.to_numpy(zero_copy_only=False)))
                wins.add(s.take(pa.array(at)).to_pylist(), p, both - p)
        if kind is not None:
            yield from wins.rows(kind)

    schema = T.StructType([T.StructField("b", T.IntegerType()), rows.schema["s"], *(T.StructField(c, T.LongType()) for c in "pq"), T.StructField("more", T.DoubleType())])
    drawn = rows.repartitionByRange(tasks, "s", "key").sortWithinPartitions("s", "key").mapInArrow(drawn_by_md5, schema)
    each = drawn.groupBy("b", "s").agg(*(F.sum(c).alias(c) for c in ("p", "q", "more")))
    # of each replicate at most three rows a task
    below = F.coalesce(F.sum("q").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs, wins = F.sum("p") * F.sum("q"), F.sum(F.col("p") * (F.col("below") + F.col("q") / F.lit(2.0)) + F.col("more"))
    values = each.withColumn("below", below).groupBy("b").agg(F.when(pairs > 0, wins / pairs).alias("auc"))
    low, high = (1 - ci) / 2, (1 + ci) / 2
    return values.agg(F.percentile("auc", low).alias("ci_low"), F.percentile("auc", high).alias("ci_high"), F.count("auc").alias("replicates"))


#: Different rows of a block of the bootstrap, and weights that a task makes at once.
CELL_BLOCK, WEIGHTS = 256, 1 << 18


def bootstrap_weights(df: DataFrame, columns: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(b, columns, w): how often the rows with these values are drawn when as many rows as there are are drawn with replacement.

    Equal rows are drawn together. In each replicate the draws are shared out over blocks of different rows by a binary tree of binomial
    splits, whose numbers on its own path a block works out for itself, and within a block by a multinomial draw; so
    the weights of a replicate add up to the number of rows. Rows that aren't drawn are left out. Draws depend on seed,
    replicate and values alone; the work grows with the different rows times the replicates.
    """
    cells = df.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(*columns))
    path = fresh_folder(df.sparkSession, "cells")
    cells.write.parquet(path)
    cells = df.sparkSession.read.parquet(path)
    total, different = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    blocks = max(1, min(1 << 16, -(-different // CELL_BLOCK)))
    dealt = cells.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, dtype=np.int64)
    for b, n in dealt.groupBy("block").agg(F.sum("n")).collect():
        sizes[b] = n
    step = max(1, min(replicates, WEIGHTS * blocks // max(1, different)))
    parts = -(-replicates // step)
    each = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        b, part = table["block"][0].as_py(), table["part"][0].as_py()
        n = table["n"].to_numpy().astype(np.float64)
        takes = share_of(b, sizes, np.full(replicates, total), seed, binomial)
        at = np.arange(part * step, min(replicates, (part + 1) * step))
        drawn = np.stack([generator(seed, b, int(r), 1).multinomial(takes[r], n / n.sum()) for r in at])
        r, cell = np.nonzero(drawn)
        rows = table.select(columns).take(pa.array(cell))
        return pa.table([pa.array(at[r].astype(np.int32)), *rows.columns, pa.array(drawn[r, cell])], names=["b", *columns, "w"])

    schema = T.StructType([T.StructField("b", T.IntegerType()), *[df.select(*columns).schema[c] for c in columns], T.StructField("w", T.LongType())])
    return each.groupBy("block", "part").applyInArrow(run, schema)


def bootstrap_ci(df: DataFrame, metrics: dict[str, Callable[[DataFrame], DataFrame]], columns: list[str], replicates: int = 1000, seed: int = 42, ci: float = 0.95) -> DataFrame:
    """(metric, ci_low, ci_high, replicates): percentile intervals of any metrics under the bootstrap.

    A metric takes rows of (b, columns, w), where w is the number of times that such rows were drawn in replicate b (see
    bootstrap_weights), and returns (b, value). Replicates in which it is null are left out.
    """
    weighted = bootstrap_weights(df, columns, replicates, seed)
    path = fresh_folder(df.sparkSession, "weights")
    weighted.write.parquet(path)
    weighted, values = df.sparkSession.read.parquet(path), None
    for name, metric in metrics.items():
        own = metric(weighted).select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        values = own if values is None else values.unionByName(own)
    low, high = (1 - ci) / 2, (1 + ci) / 2
    return values.groupBy("metric").agg(F.percentile("value", low).alias("ci_low"), F.percentile("value", high).alias("ci_high"), F.count("value").alias("replicates"))


def paired_robustness(df: DataFrame) -> DataFrame:
    """Clean and changed predictions of the same items (truth, p_clean, p_changed, failed): accuracies and AUCs both ways, their
    differences, flips, mean change and failures."""
    t = F.col("truth") == 1
    clean, changed = F.col("p_clean") >= 0.5, F.col("p_changed") >= 0.5
    n = F.count("*")
    out = df.agg(
        n.alias("n"), share(F.count_if(clean == t), n).alias("accuracy_clean"), share(F.count_if(changed == t), n).alias("accuracy_changed"),
        share(F.count_if(clean != changed), n).alias("flip_rate"), F.avg(F.abs(F.col("p_clean") - F.col("p_changed"))).alias("mean_abs_change"), share(F.count_if("failed"), n).alias("failure_rate"),
    )
    auc = lambda p, name: roc_auc(df, p, t).select(F.col("auc").alias(name))
    out = out.crossJoin(auc("p_clean", "auc_clean")).crossJoin(auc("p_changed", "auc_changed"))
    return out.withColumns({"accuracy_delta": F.col("accuracy_changed") - F.col("accuracy_clean"), "auc_delta": F.col("auc_changed") - F.col("auc_clean")})


def binomial_ci(spark: SparkSession, df: DataFrame, k: str, n: str, level: float = 0.95) -> DataFrame:
    """df with the exact (Clopper-Pearson) interval of k of n, by bisection on the incomplete beta function."""
    half = (1 - level) / 2

    def root(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if f(mid) else (mid, high)
        return (low + high) / 2

    @F.pandas_udf("struct<ci_low:double,ci_high:double>")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(ks.astype(int), ns.astype(int), strict=True):
            low = 0.0 if a == 0 else root(lambda p, a=a, b=b: incomplete_beta(a, b - a + 1, p) >= half)
            high = 1.0 if a == b else root(lambda p, a=a, b=b: 1 - incomplete_beta(a + 1, b - a, p) <= half)
            rows.append((low, high))
        return pd.DataFrame(rows, columns=["ci_low", "ci_high"])

    return df.withColumn("ci", interval(F.col(k), F.col(n))).select(*df.columns, "ci.ci_low", "ci.ci_high")
