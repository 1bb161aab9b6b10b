"""Views that stand for responses, citations, coverage, tiles and calls, derived from the given tables.

The same SQL text runs in Spark and in the oracle. Tiles are packed from the orders in stacks; `pixels` says the same in SQL.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import TILE, _binary

_PROMPT = "CASE l_returnflag WHEN 'A' THEN 'co_p1' WHEN 'N' THEN 'cte_p1' ELSE 'etc_p1' END"
#: Tiles have 8 x 8 pixels in 4 x 4 cells; some cells are near-white.
_LIGHT = "(floor(ys.y / 2) * 4 + floor(xs.x / 2) + o_orderkey) % 5 = 0"

VIEWS = {
    "annotations": """
        SELECT o_orderkey AS image_id, CAST((o_custkey + o_orderkey) % 8 AS INT) AS ssa_votes,
               CASE WHEN (o_custkey + o_orderkey) % 8 >= 4 THEN 'SSA' ELSE 'HP' END AS label,
               CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS partition
        FROM orders""",
    "responses": f"""
        SELECT l_orderkey AS image_id, l_linenumber AS replicate, {_PROMPT} AS prompt_id,
               l_partkey * 100000 + l_suppkey AS seq,
               CASE WHEN (l_partkey + l_suppkey) % 11 = 0 THEN NULL
                    WHEN (l_partkey + l_orderkey) % 2 = 0 THEN 'SSA' ELSE 'HP' END AS label_pred,
               l_quantity / CAST(50 AS DOUBLE) AS confidence
        FROM lineitem""",
    "citations": f"""
        SELECT l_orderkey AS image_id, l_linenumber AS replicate, {_PROMPT} AS prompt_id,
               l_partkey * 100000 + l_suppkey AS seq, k.i AS item,
               CASE k.i WHEN 0 THEN 'architecture' WHEN 1 THEN 'serration' ELSE 'stroma' END AS feature,
               CAST((l_partkey * (2 * k.i + 1) + l_linenumber * 5 + l_suppkey * k.i) % 16 AS INT) AS cell_idx
        FROM lineitem CROSS JOIN (VALUES (0), (1), (2)) AS k(i)""",
    "coverage": """
        SELECT o_orderkey AS image_id, CAST(c.cell_idx AS INT) AS cell_idx,
               substr('ABCD', 1 + CAST(floor(c.cell_idx / 4) AS INT), 1) || CAST(c.cell_idx % 4 + 1 AS STRING) AS cell,
               CAST(((o_orderkey * 37 + c.cell_idx * 101 + o_custkey) % 1000) / 10.0 AS DOUBLE) AS tissue_pct
        FROM orders CROSS JOIN range(16) AS c(cell_idx)""",
    "pixels": f"""
        SELECT o_orderkey AS image_id, CAST(ys.y AS INT) AS y, CAST(xs.x AS INT) AS x,
               CAST(CASE WHEN {_LIGHT} THEN 245 ELSE 120 + (o_orderkey * 7 + xs.x * 5 + ys.y * 3) % 120 END AS INT) AS r,
               CAST(CASE WHEN {_LIGHT} THEN 244 ELSE 60 + (o_orderkey * 3 + xs.x * 11 + ys.y) % 120 END AS INT) AS g,
               CAST(CASE WHEN {_LIGHT} THEN 246 ELSE 110 + (o_orderkey + xs.x + ys.y * 13) % 120 END AS INT) AS b
        FROM orders CROSS JOIN range(8) AS ys(y) CROSS JOIN range(8) AS xs(x)""",
    "calls": """
        SELECT event_id AS seq, ts, event_type AS experiment, user_id AS image_id,
               CASE WHEN event_id % 13 = 0 THEN NULL WHEN value < 50 THEN 'HP' ELSE 'SSA' END AS predicted_label,
               CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,
               value / CAST(100 AS DOUBLE) AS latency_seconds, event_id % 29 = 0 AS failed
        FROM events""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = re.search(r"FROM (\w+)", VIEWS[name])[1]
    return spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def drawn(image_id: np.ndarray) -> np.ndarray:
    """The tiles of these numbers, n x 8 x 8 x 3 bytes."""
    i, y, x = image_id[:, None, None], np.arange(8)[None, :, None], np.arange(8)[None, None, :]
    light = (y // 2 * 4 + x // 2 + i) % 5 == 0
    colour = (120 + (i * 7 + x * 5 + y * 3) % 120, 60 + (i * 3 + x * 11 + y) % 120, 110 + (i + x + y * 13) % 120)
    return np.stack([np.where(light, white, c) for white, c in zip((245, 244, 246), colour, strict=True)], axis=-1).astype(np.uint8)


#: Tiles that are drawn at once.
DRAWN = 2048


def tiles(ids: DataFrame) -> DataFrame:
    """The packed tiles of (image_id)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, DRAWN):
                ids = batch.column(0).slice(i, DRAWN)
                side = pa.array(np.full(len(ids), 8, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([ids, side, side, _binary(drawn(ids.to_numpy()))], names=["image_id", "height", "width", "rgb"])

    return ids.select(F.col("image_id").cast("long").alias("image_id")).mapInArrow(run, TILE)
