"""Keys of requests, batch scoring through a cache, zero-shot scores, pooled embeddings and linear probes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import append_ledger, read_cache, write_cache
from ..sources.shared import fresh_folder
from .metrics import log_loss, roc_auc


def image_key(mode: Column, width: Column, height: Column, data: Column) -> Column:
    """SHA-256 of mode, size and bytes."""
    return F.sha2(F.concat(F.concat_ws("|", mode, width.cast("string"), height.cast("string")).cast("binary"), data), 256)


def cache_key(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def score_batch(requests: DataFrame, scorer: Callable[[str], str], key: str = "cache_key", prompt: str = "prompt", max_new: int | None = None) -> DataFrame:
    """(key, answer, error, latency_seconds) for requests without cached answer; hits are left to cache_lookup.

    max_new caps paid calls (the cap is the feature): the misses with the smallest keys are called. An error is
    kept as its row's text and stops nothing.
    """
    todo = requests.select(key, prompt).dropDuplicates([key])
    if max_new is not None:
        todo = todo.orderBy(key).limit(max_new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p in zip(pdf[key], pdf[prompt], strict=True):
                began = time.perf_counter()
                try:
                    answer, error = scorer(p), None
                except Exception as e:  # noqa: BLE001  whatever the scorer raises is that row's result
                    answer, error = None, f"{type(e).__name__}: {e}"
                rows.append((k, answer, error, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=[key, "answer", "error", "latency_seconds"])

    return todo.mapInPandas(run, f"{key} string, answer string, error string, latency_seconds double")


def score_run(
    requests: DataFrame, scorer: Callable[[str], str], cache: str, ledger: str, max_new: int | None = None, key: str = "cache_key", prompt: str = "prompt", run: str | None = None
) -> DataFrame:
    """Answer requests from the cache, call the scorer for the others, and record both: the run's rows of the ledger.

    Answers go to the cache before the ledger, so a run that breaks off pays for none twice; a run that is repeated under its
    name enters the ledger once. max_new caps the misses that are called; requests beyond it stay for a later run. Errors
    are recorded and not cached.
    """
    spark, todo = requests.sparkSession, requests.select(key, prompt).dropDuplicates([key])
    known = read_cache(spark, cache, todo, key, f"{key} string, answer string").select(key, "answer")
    called = score_batch(todo.join(known, key, "left_anti"), scorer, key, prompt, max_new)
    path = fresh_folder(spark, "called")
    called.write.parquet(path)
    called = spark.read.parquet(path)
    write_cache(called.where("error IS NULL").select(key, "answer"), cache, key)
    hits = known.select(key, "answer", F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("latency_seconds"), F.lit(True).alias("cache_hit"))
    out = hits.unionByName(called.withColumn("cache_hit", F.lit(False)))
    folder = fresh_folder(spark, "run")
    out.write.parquet(folder)
    out = spark.read.parquet(folder)
    append_ledger(out, ledger, run or uuid.uuid4().hex)
    return out


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def zero_shot(items: DataFrame, classes: DataFrame, item: str, scale: float = 1.0) -> DataFrame:
    """Class probabilities of each item: softmax of scaled inner products with class vectors (class, class_vector)."""
    scored = items.crossJoin(F.broadcast(classes)).withColumn("logit", scale * dot("embedding", "class_vector"))
    w = Window.partitionBy(item)
    p = F.exp(F.col("logit") - F.max("logit").over(w))
    out = scored.withColumn("e", p).withColumn("probability", F.col("e") / F.sum("e").over(w))
    return out.select(item, "class", "logit", "probability")


def argmax_class(scores: DataFrame, item: str) -> DataFrame:
    """The most probable class; ties to the smaller one."""
    best = F.max(F.struct("logit", (-F.col("class")).alias("c"), "probability"))
    return scores.groupBy(item).agg(best.alias("b")).select(item, (-F.col("b.c")).alias("predicted"), F.col("b.probability").alias("confidence"))


def mean_vectors(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Element-wise mean by group, in two groupings of single components."""
    each = df.select(by, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean_vector"))


def pool_tokens(tokens: DataFrame, item: str, token: str, vector: str) -> DataFrame:
    """The class token (0) followed by the mean of the other tokens."""
    first = tokens.where(F.col(token) == 0).select(item, F.transform(vector, lambda x: x.cast("double")).alias("head"))
    rest = mean_vectors(tokens.where(F.col(token) > 0), item, vector)
    return first.join(rest, item).select(item, F.concat("head", "mean_vector").alias("pooled"))


def extract_embeddings(items: DataFrame, make_encoder: Callable[[], Callable[[list], list]], item: str, data: str, dim: int) -> DataFrame:
    """(item, embedding) by an encoder that each task makes once; vectors of another length are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for pdf in batches:
            vectors = encode(pdf[data].tolist())
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"the encoder must return vectors of {dim} numbers")
            yield pd.DataFrame({item: pdf[item], "embedding": vectors})

    return items.select(item, data).mapInPandas(run, f"{item} long, embedding array<float>")


def linear_probe(train: DataFrame, vector: str, label: str, weight_decay: float = 1e-4, rounds: int = 50):
    """A softmax classifier on embeddings."""
    rows = train.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=rounds, regParam=weight_decay, family="multinomial").fit(rows)


def probe_scores(model, test: DataFrame, vector: str, label: str, item: str) -> DataFrame:
    """(item, label, predicted, p_true, p_positive)"""
    rows = test.select(item, array_to_vector(vector).alias("features"), F.col(label).cast("int").alias("label"))
    out = model.transform(rows).withColumn("p", vector_to_array("probability"))
    return out.select(item, "label", F.col("prediction").cast("int").alias("predicted"), F.coalesce(F.try_element_at("p", F.col("label") + 1), F.lit(0.0)).alias("p_true"), F.coalesce(F.try_element_at("p", F.lit(2)), F.lit(0.0)).alias("p_positive"))


def probe_evaluate(scores: DataFrame) -> DataFrame:
    """Accuracy, AUC of the positive class (1) and cross entropy of (label, predicted, p_true, p_positive)."""
    accuracy = scores.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    auc = roc_auc(scores, "p_positive", F.col("label") == 1).select(F.col("auc").alias("roc_auc"))
    return accuracy.crossJoin(auc).crossJoin(log_loss(scores, F.col("p_true")).select(F.col("log_loss").alias("loss"), "n"))
