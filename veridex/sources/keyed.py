"""A keyed store: rows by key in sorted files under a commit log; the latest write of a key wins.

A write deals its rows out by ranges of the key and sorts each file, so every file covers a range of its own within its run; the
commit notes the least and greatest key of each. A lookup reads the log, keeps the files whose range holds a prefix of a
wanted key, and takes of each key the row of the latest commit. Compaction merges all runs into one that replaces them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import SEQ, Log

#: Characters of a key that decide which files are read; at most 16 ** 4 prefixes of hexadecimal keys come to the driver.
PREFIX = 4
#: Of longer alphabets no more prefixes than this are looked at; beyond it the range of all wanted keys decides.
MOST_PREFIXES = 1 << 16
FILE_ROWS = 1 << 20


def _latest(rows: DataFrame, key: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (key, "_seq")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_seq").alias("_row")).select(key, "_row.*")


def _sorted_files(log: Log, df: DataFrame, key: str, file_rows: int) -> tuple[list[str], list]:
    files = max(1, -(-df.count() // file_rows))
    names = log.write_files(df.repartitionByRange(files, key).sortWithinPartitions(key))
    if not names:
        return [], []
    place = F.split("_metadata.file_path", "/")
    read = df.sparkSession.read.schema(df.schema).parquet(*[f"{log.path}/data/{n}" for n in names])
    ends = read.groupBy(F.concat_ws("/", F.element_at(place, -2), F.element_at(place, -1)).alias("f")).agg(F.min(key), F.max(key)).collect()  # a row a file
    return [r[0] for r in ends], [[r[1], r[2]] for r in ends]


def put(df: DataFrame, path: str, key: str, batch: str | None = None, file_rows: int = FILE_ROWS) -> bool:
    """Write rows (of one key, any of them wins); the same batch again changes nothing. Rows with a null key are an error."""
    log, batch = Log(df.sparkSession, path), batch or uuid.uuid4().hex
    if any(e["batch"] == batch for e in log.entries()):
        return False
    checked = df.dropDuplicates([key]).withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit("null key")).cast(df.schema[key].dataType)))
    files, ranges = _sorted_files(log, checked.select(*df.columns), key, file_rows)
    return log.commit(batch, files, df.schema, ranges=ranges)


def files_of(spark: SparkSession, path: str, keys: DataFrame | None, key: str) -> list[tuple[int, str]]:
    """(version, file) of all live files that may hold one of the keys, or of all."""
    live = Log(spark, path).live()
    every = [(e["version"], f, low, high) for e in live for f, (low, high) in zip(e["files"], e["ranges"], strict=True)]
    if keys is None:
        return [(v, f) for v, f, _, _ in every]
    found = sorted(r[0] for r in keys.where(F.col(key).isNotNull()).select(F.substring(key, 1, PREFIX)).distinct().limit(MOST_PREFIXES + 1).collect())
    if len(found) > MOST_PREFIXES:
        least, most = keys.agg(F.min(key), F.max(key)).first()
        return [(v, f) for v, f, low, high in every if low <= most and least <= high]
    from bisect import bisect_left

    out = []
    for v, f, low, high in every:
        at = bisect_left(found, low[:PREFIX])
        if at < len(found) and found[at] <= high[:PREFIX]:
            out.append((v, f))
    return out


def _rows(spark: SparkSession, path: str, files: list[tuple[int, str]]) -> DataFrame | None:
    log = Log(spark, path)
    live = log.live()
    if not live or not files:
        return None
    columns = T.StructType.fromJson(live[-1]["schema"])
    rows = spark.read.schema(columns).parquet(*[f"{log.path}/data/{f}" for _, f in files])
    place = F.split("_metadata.file_path", "/")
    rows = rows.select("*", F.element_at(place, -2).alias("_folder"), F.element_at(place, -1).alias("_file"), F.col("_metadata.row_index").alias("_line"))
    table = spark.createDataFrame(sorted({(f.split("/")[0], v) for v, f in files}), "_folder string, _version long")
    seq = F.struct(F.col("_version").alias("version"), F.col("_file").alias("file"), F.col("_line").alias("line"))
    return rows.join(F.broadcast(table), "_folder").select(*columns.names, seq.cast(SEQ).alias("_seq"))


def get(spark: SparkSession, path: str, keys: DataFrame | None, key: str, schema: str | None = None) -> DataFrame:
    """The latest row of each of the keys (or of all); files outside their ranges aren't read. schema: that of an empty store."""
    rows = _rows(spark, path, files_of(spark, path, keys, key))
    if rows is None:
        live = Log(spark, path).live()
        return spark.createDataFrame([], T.StructType.fromJson(live[-1]["schema"]) if live else schema)
    if keys is not None:
        rows = rows.join(keys.select(key).distinct(), key, "left_semi")
    return _latest(rows, key)


def compact(spark: SparkSession, path: str, key: str, file_rows: int = FILE_ROWS) -> bool:
    """All runs merged into one, latest rows alone; False if there is nothing to merge, or another commit came between."""
    log = Log(spark, path)
    live = log.live()
    if len(live) < 2:
        return False
    rows = _rows(spark, path, files_of(spark, path, None, key))
    if rows is None:
        return False
    columns = T.StructType.fromJson(live[-1]["schema"])
    files, ranges = _sorted_files(log, _latest(rows, key).select(*columns.names), key, file_rows)
    return log.commit(f"compaction-{uuid.uuid4().hex}", files, columns, kind="replace", after=live[-1]["version"], ranges=ranges)
