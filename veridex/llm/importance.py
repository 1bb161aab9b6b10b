"""Importance resampling toward a target distribution, ranked by parallel sorting by regular sampling.

Features are runs of 1 to 3 words, hashed into buckets by CRC-32. Two passes over the texts: one counts the buckets of raw
and target documents, which give every bucket a gain (a scaled log ratio, in one array); the next adds up the gains of each
document's features. A document's score is that weight plus scaled Gumbel noise from a digest of its id, so the
documents with the highest scores are a draw without replacement in proportion to exp(weight).

Ranks: scored rows are written in sorted runs, one a task. Rows at regular places of the runs give splitters; every run is
cut at them, sizes of the segments tell which ones the draw reaches, and only rows of those are exchanged. Each segment is merged
in a task of its own, and what lies before it (prefix sums of sizes) completes its ranks. Splitters hold the whole order
(score, doc_id, number of features, place of the row), so equal scores or ids are split as well. The number of samples is
bounded by SEGMENTS[1] * SAMPLES in the mean; they decide balance alone, never results.

CRCs of runs come from those of words: the CRC register after a word is linear in the register before it, by tables for each length.

Nulls: a null text has no features, weight 0 and is never drawn; a null doc_id draws like the empty string, after all
others of its score. Repeated rows are documents of their own. Without documents the result is empty; without target texts all
features gain by their rarity alone. doc_id is a whole number. Texts of any length are read whole, STEP words at a
time. Of other columns none is returned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from . import text as T
from .store import written

RUN, BUCKETS, SCALE, SEED = 3, 10_000, 1000, 42
LEAST_WORDS, PERCENT = 20, 5
#: Words whose features are hashed at once.
STEP = 1 << 18
#: Least and most segments, rows of one between these bounds, and regular samples a segment.
SEGMENTS, SEGMENT_ROWS, SAMPLES = (256, 8192), 100_000, 16

_C = np.uint32
_ONES = _C(0xFFFFFFFF)
LONG = T.LONG_WORD


def _byte_step() -> np.ndarray:
    """The CRC-32 register after each byte, from register 0."""
    c = np.arange(256, dtype=_C)
    for _ in range(8):
        c = np.where(c & _C(1), (c >> _C(1)) ^ _C(0xEDB88320), c >> _C(1))  # fixed value: the reflected polynomial
    return c


_STEP = _byte_step()


def _zero_steps() -> np.ndarray:
    """[n, k, b]: register b << 8 * k after n zero bytes."""
    at = np.arange(256, dtype=_C)[None, :] << (_C(8) * np.arange(4, dtype=_C)[:, None])
    out = [at]
    for _ in range(LONG + 1):
        at = _STEP[at & _C(255)] ^ (at >> _C(8))
        out.append(at)
    return np.stack(out).reshape(-1)


_ZEROS = _zero_steps()


def _after(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n zero bytes each, n at most LONG + 1."""
    at = n * 1024
    out = _ZEROS[at + (register & _C(255))]
    for k in (1, 2, 3):
        out ^= _ZEROS[at + 256 * k + ((register >> _C(8 * k)) & _C(255))]
    return out


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int = RUN) -> list[np.ndarray]:
    """[k]: CRC-32 of the k + 1 words from each word on, joined by one space (the last k words begin none)."""
    sizes = ends - starts
    short = np.minimum(sizes, LONG)
    own = np.zeros(len(starts), dtype=_C)  # registers after each word, from 0
    for at in range(int(short.max(initial=0))):
        active = np.flatnonzero(short > at)
        own[active] = _STEP[(own[active] ^ data[starts[active] + at]) & _C(255)] ^ (own[active] >> _C(8))
    spaced = _after(np.full(len(own), _STEP[0x20]), short) ^ own
    long_words = np.flatnonzero(sizes > LONG)
    register = _after(np.full(len(own), _ONES), short) ^ own
    for i in long_words:
        register[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes()) ^ 0xFFFFFFFF
    out = [register]
    for k in range(1, longest):
        before = out[-1][: len(starts) - k]
        if len(starts) <= k:
            out.append(before[:0])
            continue
        register = _after(before, short[k:] + 1) ^ spaced[k:]
        for i in long_words[long_words >= k]:
            register[i - k] = zlib.crc32(b" " + data[starts[i] : ends[i]].tobytes(), int(before[i - k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        out.append(register)
    return [r ^ _ONES for r in out]


def _features(part: pa.RecordBatch, use: Callable[[np.ndarray, np.ndarray], None], buckets: int) -> np.ndarray:
    """Hand (places of words, bucket) of all features to use, STEP words at a time; the index of each row's first word."""
    data, offsets = T.utf8(part.column("text"))
    data = T.lower_ascii(data)
    starts, ends, first = T.words(data, offsets, T.ALPHANUMERIC)
    last = np.repeat(first[1:], np.diff(first))  # the end of each word's row
    for a in range(0, len(starts), STEP):
        z = min(len(starts), a + STEP + RUN - 1)
        for k, crc in enumerate(run_crcs(data, starts[a:z], ends[a:z])):
            at = a + np.arange(min(len(crc), STEP))
            inside = at + k < last[at]
            use(at[inside], (crc[: len(at)][inside] % _C(buckets)).astype(np.int64))
    return first


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, dtype=np.int64)

        def add(_at: np.ndarray, bucket: np.ndarray) -> None:
            nonlocal found
            found += np.bincount(bucket, minlength=buckets)

        for part in T.slices(batches, "text"):
            _features(part, add, buckets)
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(found[seen])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    each = texts.select("text").where("text IS NOT NULL").mapInArrow(T.releasing(run), "bucket int, n long")
    for bucket, n in each.groupBy("bucket").agg(F.sum("n")).collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Each bucket's scaled log ratio of smoothed shares, rounded down."""
    a, b = float(raw.sum()) + len(raw), float(target.sum()) + len(target)
    return np.array([math.floor(scale * math.log((float(t) + 1) * a / ((float(s) + 1) * b))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            sums = [np.zeros(0, dtype=np.int64)]

            def add(at: np.ndarray, bucket: np.ndarray) -> None:
                if len(at) and at[-1] >= len(sums[0]):
                    sums[0] = np.concatenate([sums[0], np.zeros(int(at[-1]) + 1 - len(sums[0]), dtype=np.int64)])
                sums[0][at] += gain[bucket]  # places of one call are different

            first = _features(part, add, len(gain))
            total = np.r_[0, np.cumsum(sums[0])]
            n = np.diff(first)
            features = sum(np.maximum(n - k, 0) for k in range(RUN))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(features), pa.array(total[first[1:]] - total[first[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(T.releasing(run), "doc_id long, n_words long, n_features long, weight long")


def with_score(rows: DataFrame, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """weight plus scaled Gumbel noise from the first 32 bits of a digest of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 32))
    return rows.withColumn("score", F.col("weight") + F.floor(F.lit(-float(scale)) * F.ln(-F.ln(u))).cast("long"))


#: The order of rows: highest score first, then smaller doc_id (null last); the rest tells equal ones apart.
_ORDER = ("down", "no_id", "id", "n_features", "file", "row")


def _keys() -> list:
    file, row = F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")
    return [(-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "n_features", file.alias("file"), row.alias("row")]


def _segments(part: pa.RecordBatch, splitters: np.ndarray) -> np.ndarray:
    """How many splitters lie at or before each row."""
    keys = [np.concatenate([splitters[:, i], np.asarray(part.column(c))]) for i, c in enumerate(_ORDER)]
    mark = np.r_[np.zeros(len(splitters), dtype=np.int64), np.ones(part.num_rows, dtype=np.int64)]
    order = np.lexsort([mark, *keys[::-1]])
    out = np.empty(len(order), dtype=np.int32)
    out[order] = np.cumsum(mark[order] == 0)
    return out[len(splitters) :]


def ranked(scored: DataFrame, drawn: Callable[[int], int], least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, n_features, score, ...) with rank: 1, 2, ... for the drawn(N) best of the N rows with enough words."""
    spark = scored.sparkSession
    enough = F.col("n_words") >= least_words
    runs = written(scored.sortWithinPartitions(enough.desc(), F.desc("score"), F.col("doc_id").asc_nulls_last(), "n_features"), "runs")
    able = runs.where(enough)
    n = able.count()
    k = drawn(n)
    count = max(SEGMENTS[0], min(SEGMENTS[1], n // SEGMENT_ROWS))
    gap = max(1, n // (count * SAMPLES))
    # each run starts at a place of its own, so runs shorter than the gap are sampled as well
    regular = able.select(*_keys()).where(F.pmod(F.col("row") + F.pmod("file", F.lit(gap)), F.lit(gap)) == 0)
    samples = sorted(tuple(r) for r in regular.collect())
    # the samples' positions at equal distances are the splitters
    splitters = np.array(samples[SAMPLES - 1 :: SAMPLES], dtype=np.int64).reshape(-1, len(_ORDER))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(splitters) + 1, dtype=np.int64)
        for part in batches:
            found += np.bincount(_segments(part, splitters), minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found).astype(np.int32)), pa.array(found[found > 0])], names=["segment", "n"])

    size = np.zeros(len(splitters) + 1, dtype=np.int64)
    for segment, m in able.select(*_keys()).mapInArrow(sizes, "segment int, n long").groupBy("segment").agg(F.sum("n")).collect():
        size[segment] = m
    before = np.cumsum(size) - size
    reached = int(np.searchsorted(before, k, side="left"))  # segments from here on begin after the last drawn row

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            able_rows = np.asarray(part.column("n_words")) >= least_words
            segment = np.where(able_rows, _segments(part, splitters), len(splitters) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(segment)], names=[*part.schema.names, "segment"])

    whole = runs.select(*runs.columns, *[c for c in _keys() if isinstance(c, Column)])
    tagged = whole.mapInArrow(placed, StructType([*whole.schema.fields, StructField("segment", IntegerType())]))
    table = spark.createDataFrame([(i, int(b)) for i, b in enumerate(before[:reached])], "segment int, before long")
    inner = Window.partitionBy("segment").orderBy(*_ORDER)
    rank = F.row_number().over(inner) + F.col("before")
    best = tagged.join(F.broadcast(table), "segment").withColumn("rank", rank)
    best = best.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")).cast("long"))
    rest = tagged.where(F.col("segment") >= reached).withColumn("rank", F.lit(None).cast("long"))
    return best.select(*runs.columns, "rank").unionByName(rest.select(*runs.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of docs (doc_id, text), drawn toward target (text)."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return ranked(with_score(weighed(docs, gain), seed), lambda n: percent * n // 100, least_words)
