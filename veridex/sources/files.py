"""Readers and writers: ledgers, annotations, tiles, coverage documents, dimensions, embeddings, prediction caches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tiles import TILE, mapped
from . import keyed
from .commits import append_batch, read_batches

ANNOTATION_SCHEMA = "image_id string, label string, ssa_votes int, partition string"
CELL = "struct<row:int,col:int,bbox:array<int>,tissue_pct:double,tissue_pct_gray_rule:double,mean_gray:double,mean_saturation:double,is_empty:boolean,touches_tile_border:boolean>"
COVERAGE_SCHEMA = f"image string, label string, votes int, partition string, tile_tissue_pct double, empty_cells array<string>, cells map<string,{CELL}>"
CORRUPT = "_corrupt_record"


def read_ledger(spark: SparkSession, path: str, schema: str, on_bad: str = "fail") -> DataFrame:
    """JSON lines with a schema, blank lines ignored. on_bad: fail, skip, or keep (bad lines in _corrupt_record).

    seq says where a line stands: its file, the part of the file that a task reads, and its number there. It orders a ledger's
    lines as they were written, file by file, without a shuffle.
    """
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}[on_bad]
    kind = T._parse_datatype_string(schema) if on_bad != "keep" else T._parse_datatype_string(f"{schema}, {CORRUPT} string")
    lines = spark.read.schema(kind).option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select("*", seq.alias("seq"))


def parse_ledger(lines: DataFrame, column: str, schema: str, on_bad: str = "keep") -> DataFrame:
    """The same for lines that are already a column; other columns stay."""
    parsed = F.from_json(column, schema)
    ok = F.is_valid_utf8(column) & F.try_parse_json(column).isNotNull()
    out = lines.withColumns({"record": F.when(ok, parsed), "bad": ~F.coalesce(ok, F.lit(False))})
    if on_bad == "skip":
        out = out.where(~F.col("bad"))
    elif on_bad == "fail":
        out = out.withColumn("record", F.when(F.col("bad"), F.raise_error("bad line").cast(out.schema["record"].dataType)).otherwise(F.col("record")))
    return out


def append_ledger(df: DataFrame, path: str, batch: str) -> bool:
    """Append a batch under its name; readers see all of it or nothing, and the same batch again changes nothing (see commits)."""
    return append_batch(df, path, batch)


def committed_ledger(spark: SparkSession, path: str, schema: str | None = None, seq: str = "seq") -> DataFrame:
    """All committed rows with their batch and seq: the order of batches, and of lines in each."""
    return read_batches(spark, path, schema, seq_column=seq)


def read_annotations(spark: SparkSession, path: str, names: dict[str, str] | None = None, partition: str | None = None) -> DataFrame:
    """Annotations from CSV with a header; rows that break the contract (see ledger.check_annotations) are an error, and so is an
    empty partition. names: the file's name of each column, where it is another."""
    names = names or {}
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(*[F.col(names.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ANNOTATION_SCHEMA)])
    from ..operators.ledger import check_annotations

    bad = {r["rule"]: r["n_bad"] for r in check_annotations(rows).collect() if r["n_bad"]}
    if bad:
        raise ValueError(f"annotations break their contract: {bad}")
    rows = rows if partition is None else rows.where(F.col("partition") == partition)
    if partition is not None and rows.isEmpty():
        raise ValueError(f"partition {partition} is empty")
    return rows


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Images as packed tiles (image_id, height, width, rgb, origin, error), bad ones as rows with error and no bytes.

    image_id is that of a folder image_id=..., or else a hash of the file's place. Gray images have equal channels, alpha is left out.
    Spark's sources don't list files without any byte: they are missing files (see missing_files).
    """
    images = spark.read.format("image").load(path)
    i = F.col("image")
    key = F.col("image_id").cast("long") if "image_id" in images.columns else F.xxhash64(i["origin"])
    bad = (i["height"] <= 0) | (i["width"] <= 0)
    rows = images.select(key.alias("image_id"), *[F.when(~bad, i[c]).alias(c) for c in ("height", "width")], i["nChannels"].alias("channels"), i["data"].alias("data"), i["origin"].alias("origin"), F.when(bad, F.lit("not an image")).alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for data, n, error in zip(*(batch.column(c).to_pylist() for c in ("data", "channels", "error")), strict=True):
                px = None if error else np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
                # the source has blue first
                packed.append(None if error else px[:, [2, 1, 0] if n >= 3 else [0, 0, 0]].tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("image_id", "height", "width")], pa.array(packed, pa.binary()), batch.column("origin"), batch.column("error")], names=["image_id", "height", "width", "rgb", "origin", "error"])

    return rows.mapInArrow(run, f"{TILE}, origin string, error string")


def bitmap(rgb: np.ndarray) -> bytes:
    """A tile (height x width x 3 bytes) as a BMP file: a header of 54 bytes, then rows from below, blue first, in fours of bytes."""
    height, width = rgb.shape[:2]
    rows = np.zeros((height, -(-width * 3 // 4) * 4), dtype=np.uint8)
    rows[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    header = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return header + rows.tobytes()


def encode_tiles(tiles: DataFrame) -> DataFrame:
    """(image_id, data): packed tiles as files of images."""
    return mapped(tiles, lambda rgb, rows: {"data": pa.array([bitmap(t) for t in rgb], pa.binary())}, "data binary")


def write_images(files: DataFrame, path: str) -> None:
    """One file for each row of (image_id, data), in a folder of its own, by Spark's writers alone: a text of the bytes as they are.

    A file costs its opening, not its bytes, so rows are dealt out to a fixed number of tasks, which Spark doesn't coalesce by size.
    The tasks move their files to their place themselves (version 2), as the driver would move them one by one.
    """
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    files.select("image_id", F.col("data").cast("string").alias("data")).repartition(tasks, "image_id").write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("image_id").text(path)


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """(file) of all files of a folder, without reading their content."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))


def missing_files(annotations: DataFrame, files: DataFrame, key: str, file: str) -> DataFrame:
    """Annotated items without a file."""
    return annotations.join(files.select(F.col(file).alias(key)), key, "left_anti")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """One row a cell, from one JSON document a tile."""
    docs = spark.read.schema(COVERAGE_SCHEMA).option("multiLine", True).json(path)
    return coverage_rows(docs)


def coverage_rows(docs: DataFrame) -> DataFrame:
    each = docs.select("image", F.explode("cells").alias("cell", "c"))
    return each.select("image", "cell", "c.*")


def coverage_documents(cells: DataFrame, key: str = "image_id") -> DataFrame:
    """One document a tile: its cells by name, least and most tissue, and the number of empty cells."""
    entry = F.struct("cell", F.struct("tissue_pct", "is_empty").alias("value"))
    return cells.groupBy(key).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("cells"), F.min("tissue_pct").alias("min_cell_pct"), F.max("tissue_pct").alias("max_cell_pct"), F.count_if("is_empty").alias("n_empty")
    )


def write_coverage(cells: DataFrame, path: str, key: str = "image_id") -> None:
    """Documents as JSON lines, and a flat index as CSV."""
    docs = coverage_documents(cells, key)
    docs.write.mode("overwrite").json(f"{path}/documents")
    docs.drop("cells").write.mode("overwrite").option("header", True).csv(f"{path}/index")


def stream_split(source: DataFrame, partition: str, max_samples: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """A pinned split, and its first rows in stream order (ordinals count within the split)."""
    out = source.where(F.col("partition") == partition)
    return out if max_samples is None else out.where(F.col(ordinal) < max_samples)


def manifest(df: DataFrame, by: list[str], order: str, *columns: str, part_size: int = 4096, **parameters) -> DataFrame:
    """Selections with their parameters, as documents of at most part_size values of the (whole, distinct) order column each."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    fixed = [F.lit(v).alias(k) for k, v in parameters.items()]
    part = F.floor(F.col(order) / F.lit(part_size)).alias("part")
    return df.groupBy(*by, part).agg(F.to_json(F.struct(*fixed, rows.alias("items"))).alias("document"), F.count("*").alias("n_items"))


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small table from one JSON document, to be broadcast."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def check_embeddings(df: DataFrame, vector: str, label: str, dim: int) -> DataFrame:
    """Rows, vectors of another length than dim, and missing labels."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dim).alias("bad_length"), F.count_if(F.col(label).isNull()).alias("null_label"))


def save_embeddings(df: DataFrame, path: str, vector: str, label: str, dim: int) -> None:
    bad = check_embeddings(df, vector, label, dim).first()
    if bad["bad_length"] or bad["null_label"]:
        raise ValueError(f"not saved: {bad.asDict()}")
    df.write.mode("overwrite").parquet(path)


def write_cache(df: DataFrame, path: str, key: str = "cache_key", batch: str | None = None) -> bool:
    """Content-addressed results into a keyed store; of a key that is written again the latest write wins."""
    return keyed.put(df, path, key, batch)


def read_cache(spark: SparkSession, path: str, keys: DataFrame, key: str = "cache_key", schema: str | None = None) -> DataFrame:
    """The cached rows of keys; only files whose range of keys holds one of them are read. schema: that of a cache that isn't there yet."""
    return keyed.get(spark, path, keys, key, schema)
