"""Substring dedup: a log-structured index of window fingerprints.

A window is `window` consecutive words of one document. Of a window's `anchor`-word grams the one with
the least hash is its fingerprint: equal windows have equal fingerprints, and neighbouring windows mostly
share theirs, so an index holds about 2 / (window - anchor + 2) rows a word.

`FingerprintIndex.append` writes a batch's fingerprints as a sorted immutable run (bucketed by
fingerprint), and merge-joins it with the runs before it and with itself, bucket by bucket. What meets is
a candidate. Runs are compacted to one row a fingerprint when there are too many; their list is kept beside
them, so a later session can open the index again and append.

Candidates are verified: windows of one fingerprint are compared by a 64-bit hash of all their words, and the first
one in the order of documents is found as a minimum. Those that are first go back to their documents, and every other
window of a candidate is late: its words go. Repeats within a slice of texts are settled where they are found, and of
a fingerprint that a slice holds twice one row stands for the slice in the run. The windows of hot fingerprints, which
are counted first, are dealt out one by one, so a window, however often it occurs, brings at most a row a slice to a
task, and no task gets the windows of a whole hot passage.

A document is a doc_id with a text. Documents of one doc_id are ordered by a hash of their text; equal rows are
one document and get the same result. Nulls: a null text has no words; a row with null doc_id is returned with
nothing removed and neither removes from others. Documents shorter than a window lose nothing. Texts of any
length are read whole. An empty table gives an empty result; other columns than doc_id and text are left out,
whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .heat import hot_keys
from .store import fresh_path, remove, written

WINDOW = 20
ANCHOR = 4
#: Batches in which the query's documents arrive, and runs that the index keeps before it compacts them.
BATCHES, MAX_RUNS = 3, 1
_SLICE_BYTES = 8 << 20
_POSITIONS = "slot long, key long, fingerprint long, known boolean"
_CLAIMS = "slot long, doc_id long, key long, start int, windows array<long>"
_FIRSTS = "array<struct<doc_id:bigint,start:int>>"


def _fingerprints(data, offsets, window: int, anchor: int):
    """First words of rows, word hashes, window starts, their fingerprints, and whether that gram leads the window."""
    starts, ends, first = T.words(data, offsets, T.BLANK_SEPARATED)
    h = T.word_hashes(data, starts, ends)
    whole = np.flatnonzero(T.fits(first, window))
    g = T.grams(h, anchor)
    span, size, least = window - anchor + 1, 1, g
    while size * 2 <= span:  # least over 1, 2, 4, ... grams from each position on
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = span - size
    if rest and len(least) > rest:
        least = np.minimum(least[:-rest], least[rest:])
    prints = least[whole] if len(whole) else np.zeros(0, T.U)
    return first, h, whole, prints, (g[whole] == prints if len(whole) else np.zeros(0, bool))


def _row_of(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, side="right") - 1


def _emit(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", _SLICE_BYTES):
            ids = part.column("key").to_numpy(zero_copy_only=False)
            first, _, whole, prints, leads = _fingerprints(*T.utf8(part.column("text")), window, anchor)
            rows = _row_of(first, whole)
            # consecutive windows that share one gram as fingerprint count once; a like gram further on is another
            new = np.ones(len(whole), dtype=bool)
            new[1:] = (prints[1:] != prints[:-1]) | (rows[1:] != rows[:-1]) | leads[:-1]
            rows, prints = rows[new], prints[new]
            order = np.lexsort((rows, prints))
            rows, prints = rows[order], prints[order]
            lead = np.ones(len(rows), dtype=bool)
            lead[1:] = prints[1:] != prints[:-1]
            group = np.cumsum(lead) - 1
            many = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, dtype=bool)
            known = many & np.r_[True, (rows[1:] != rows[:-1]) | lead[1:]] if len(rows) else many
            docs, prints = ids[rows].astype(np.int64), T.signed(prints)
            spread = T.signed(T.mixed(docs.view(T.U) * T._M1 + prints.view(T.U)))
            take = [np.flatnonzero(lead), np.flatnonzero(known)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[prints[take[0]], spread[take[1]]]),
                    pa.array(np.r_[docs[take[0]], docs[take[1]]]),
                    pa.array(np.r_[prints[take[0]], prints[take[1]]], mask=np.r_[np.ones(len(take[0]), bool), np.zeros(len(take[1]), bool)]),
                    pa.array(np.r_[np.zeros(len(take[0]), bool), np.ones(len(take[1]), bool)]),
                ],
                names=["slot", "key", "fingerprint", "known"],
            )

    return T.releasing(run)


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints, as bucketed tables under one folder, and the list of them.

    With a folder, the index that an earlier session left there is opened again.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, anchor: int = ANCHOR, buckets: int | None = None, max_runs: int = MAX_RUNS, folder: str | None = None):
        if not 1 <= anchor <= window:
            raise ValueError("anchor must be between 1 and window")
        self.spark, self.window, self.anchor, self.max_runs = spark, window, anchor, max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder or fresh_path(spark, "fingerprints")
        self.runs: list[str] = []
        self._version = 0
        if folder:
            self._open()

    def _open(self) -> None:
        rows = self.spark.read.schema("version int, runs array<string>, window int, anchor int, buckets int").json(f"{self.folder}/list")
        last = rows.orderBy(F.desc("version")).first()
        if (last["window"], last["anchor"]) != (self.window, self.anchor):
            raise ValueError(f"the index has windows of {last['window']} words and anchors of {last['anchor']}")
        self._version, self.runs, self.buckets = last["version"], last["runs"], last["buckets"]
        for name in self.runs:
            if not self.spark.catalog.tableExists(name):
                self.spark.sql(f"CREATE TABLE {name} ({_POSITIONS}) USING parquet OPTIONS (path '{self.folder}/{name}') CLUSTERED BY (slot) SORTED BY (slot) INTO {self.buckets} BUCKETS")

    def _commit(self, runs: list[str]) -> None:
        """The list of runs changes in one write; a run that isn't in the last list is none."""
        self._version, self.runs = self._version + 1, runs
        line = self.spark.createDataFrame([(self._version, runs, self.window, self.anchor, self.buckets)], "version int, runs array<string>, window int, anchor int, buckets int")
        line.coalesce(1).write.mode("append").json(f"{self.folder}/list")

    def _write_run(self, rows: DataFrame) -> str:
        name = f"run_{self.folder.rpartition('-')[2]}_{uuid.uuid4().hex[:8]}"
        (
            rows.repartition(self.buckets, "slot")
            .write.bucketBy(self.buckets, "slot").sortBy("slot")
            .option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        )
        return name

    def append(self, batch: DataFrame) -> DataFrame:
        """Add a batch (key, text) as a run; (key, fingerprint) of what may repeat within it or before.

        key is a number that names the row. The candidates are written, so they need no run any more.
        """
        if len(self.runs) > self.max_runs:
            self.compact()
        texts = batch.select("key", F.coalesce("text", F.lit("")).alias("text"))
        name = self._write_run(texts.mapInArrow(_emit(self.window, self.anchor), _POSITIONS))
        new = self.spark.table(name)
        own = new.where(~F.col("known"))
        # within the run: several slices hold it
        again = own.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select("slot")
        met = [own.join(again.hint("merge"), "slot", "left_semi")]
        for old in self.runs:
            past = self.spark.table(old).where(~F.col("known"))
            met.append(own.join(past.hint("merge"), "slot", "left_semi"))
            met.append(past.join(own.hint("merge"), "slot", "left_semi"))
            # rows that were known to repeat in the batch of old are candidates since then
        out = new.where("known").select("key", "fingerprint")
        for x in met:
            out = out.unionByName(x.select("key", F.col("slot").alias("fingerprint")))
        out = written(out, "candidates")
        self._commit([*self.runs, name])
        return out

    def compact(self) -> None:
        """Merge all runs into one with one row a fingerprint: rows that met have been candidates since then."""
        if len(self.runs) < 2:
            return
        rows = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            rows = rows.unionByName(self.spark.table(name))
        one = rows.where(~F.col("known")).groupBy("slot").agg(F.min("key").alias("key"))
        old, merged = self.runs, self._write_run(one.select("slot", "key", F.lit(None).cast("long").alias("fingerprint"), F.lit(False).alias("known")))
        self._commit([merged])
        self._drop(old)

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.folder}/{name}")

    def drop(self) -> None:
        """Remove the index."""
        self._drop(self.runs)
        remove(self.spark, self.folder)


def _candidate_windows(part: pa.RecordBatch, window: int, anchor: int, data: np.ndarray, offsets: np.ndarray):
    """First words of rows; and of the windows whose fingerprint is a candidate of their row: rows, first words, fingerprints."""
    first, _, whole, prints, _ = _fingerprints(data, offsets, window, anchor)
    rows = _row_of(first, whole)
    wanted = part.column("candidates")
    lengths = np.diff(wanted.offsets.to_numpy())
    wanted_prints = wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(T.U)
    keys = T.mixed(wanted_prints + np.repeat(np.arange(part.num_rows).astype(T.U), lengths) * T._M1)
    keys.sort()
    mine = T.mixed(prints + rows.astype(T.U) * T._M1)
    at = np.searchsorted(keys, mine)
    hit = np.zeros(len(mine), dtype=bool)
    inside = at < len(keys)
    hit[inside] = keys[at[inside]] == mine[inside]
    return first, rows[hit], whole[hit], prints[hit]


def _claim(window: int, anchor: int, hot):
    """The windows of candidates, in stretches of one fingerprint. Of equal ones in a slice the first is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text", _SLICE_BYTES):
            data, offsets = T.utf8(part.column("text"))
            first, rows, whole, prints = _candidate_windows(part, window, anchor, data, offsets)
            starts, ends, _ = T.words(data, offsets, T.BLANK_SEPARATED)
            w = T.grams(T.word_hashes(data, starts, ends), window)[whole] if len(whole) else np.zeros(0, T.U)
            docs, keys = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[rows] for c in ("doc_id", "key"))
            start = whole - first[rows]
            order = np.lexsort((start, keys, docs, w, prints))
            lead = np.ones(len(order), dtype=bool)
            lead[1:] = (w[order[1:]] != w[order[:-1]]) | (prints[order[1:]] != prints[order[:-1]])
            order = np.sort(order[lead])
            rows, start, prints, w, docs, keys = (x[order] for x in (rows, start, prints, w, docs, keys))
            own = np.isin(prints, hot.value)
            cut = np.ones(len(rows) + 1, dtype=bool)
            cut[1:-1] = (rows[1:] != rows[:-1]) | (start[1:] != start[:-1] + 1) | (prints[1:] != prints[:-1]) | own[1:]
            at = np.flatnonzero(cut)
            windows = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(T.signed(w)))
            at = at[:-1]
            slot = np.where(own[at], T.mixed(prints[at] + w[at] * T._M1), prints[at])
            columns = [pa.array(T.signed(slot)), pa.array(docs[at]), pa.array(keys[at]), pa.array(start[at].astype(np.int32)), windows]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "doc_id", "key", "start", "windows"])

    return T.releasing(run)


def _cut(window: int, anchor: int):
    """Rows without the words of their late windows: those of candidates that aren't first."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            data, offsets = T.utf8(part.column("text"))
            first, _, whole, _ = _candidate_windows(part, window, anchor, data, offsets)
            firsts = part.column("firsts")
            owner = np.repeat(np.arange(part.num_rows), np.diff(firsts.offsets.to_numpy()))
            docs, start = (firsts.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            mine = docs == ids[owner] if len(owner) else np.zeros(0, bool)
            late = whole[~np.isin(whole, first[owner[mine]] + start[mine])]
            drop = np.zeros(int(first[-1]) + 1, dtype=np.int64)
            np.add.at(drop, late, 1)
            np.add.at(drop, late + window, -1)
            stay = np.cumsum(drop[:-1]) == 0
            gone = np.diff(np.r_[0, np.cumsum(~stay)][first])
            starts, ends, _ = T.words(data, offsets, T.BLANK_SEPARATED)
            raw, kept = data.tobytes(), []
            for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                own = np.flatnonzero(stay[a:z]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]).decode("utf-8", "replace"))
            columns = [part.column("doc_id"), pa.array(np.diff(first)), pa.array(gone), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return T.releasing(run)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, max_runs: int = MAX_RUNS) -> DataFrame:
    """Remove the words of windows that also start earlier: (doc_id, n_words, n_removed, kept).

    The documents arrive at a FingerprintIndex in `batches` batches by doc_id, as they would over time.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts, unnamed = rows.where(F.col("doc_id").isNotNull()).withColumn("key", F.xxhash64("doc_id", "text")), rows.where(F.col("doc_id").isNull())
    index = FingerprintIndex(docs.sparkSession, window, anchor, max_runs=max_runs)
    cuts = texts.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    candidates, low = None, None
    for high in [*sorted(set(cuts)), None]:
        at = F.col("doc_id")
        mine = F.lit(True)
        if low is not None:
            mine = mine & (at >= low)
        if high is not None:
            mine = mine & (at < high)
        found, low = index.append(texts.where(mine)), high
        candidates = found if candidates is None else candidates.unionByName(found)
    index.drop()
    wanted = candidates.groupBy("key").agg(F.collect_set("fingerprint").alias("candidates"))
    # claims and cuts are joined on the same key, so texts are shuffled once for both
    counted = candidates.groupBy("fingerprint").agg(F.count("*").alias("n"))
    hot = np.array([r[0] for r in hot_keys(counted, ["fingerprint"], candidates.count()).collect()], dtype=np.int64).view(T.U)
    claims = texts.join(wanted.hint("merge"), "key").mapInArrow(_claim(window, anchor, docs.sparkSession.sparkContext.broadcast(hot)), _CLAIMS)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = claims.repartition(n, "slot").select("slot", "doc_id", "key", "start", F.posexplode("windows").alias("i", "w"))
    first = each.groupBy("slot", "w").agg(F.min(F.struct("doc_id", "key", (F.col("start") + F.col("i")).alias("start"))).alias("first"))
    firsts = first.groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct("first.doc_id", "first.start")).alias("firsts"))
    whole = texts.join(wanted.hint("merge"), "key", "left").join(firsts.hint("merge"), "key", "left").select("doc_id", "text", "candidates", "firsts")
    none = [F.lit(None).cast("array<long>").alias("candidates"), F.lit(None).cast(_FIRSTS).alias("firsts")]
    whole = whole.unionByName(unnamed.select("doc_id", "text", *none))
    filled = whole.select("doc_id", "text", F.coalesce("candidates", F.array().cast("array<long>")).alias("candidates"), F.coalesce("firsts", F.array().cast(_FIRSTS)).alias("firsts"))
    return filled.mapInArrow(_cut(window, anchor), "doc_id long, n_words long, n_removed long, kept string")


def with_digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], order, window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same by definition, for tests: sorted (doc_id, n_words, n_removed, digest). order(doc_id, text) orders documents of one id."""
    seen: set[tuple[bytes, ...]] = set()
    done: dict[tuple[int, str], tuple[int, int, str]] = {}
    for doc, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0], order(*r))):
        w = text.encode().split()
        drop = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                drop.update(range(i, i + window))
            seen.add(key)
        kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
        done[doc, text] = (len(w), len(drop), hashlib.sha256(kept).hexdigest())
    return sorted((d, *done[d, t or ""]) for d, t in rows)
