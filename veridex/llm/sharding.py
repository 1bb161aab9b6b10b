"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a ring; a key belongs to the first point clockwise from its own place.
Loads are bounded as tightly as whole rows allow: with n rows and S shards, n mod S shards hold one row more
than the others. Keys that overflow a full shard continue clockwise to the next shard with room, so the law
`rows` (counts at most one apart) always holds, while most keys stay at their home shard.

Only the number of rows in each of the S x virtual arcs comes to the driver: a table whose size the
parameters fix. From it the plan gives each arc's rows, in ring order, to shards in stretches; a row's shard
and slot then follow from its rank within its arc. DataFrame functions do the rest.

Nulls: a null doc_id is a key like any other (the empty string); a null text has size 8 and checksum 0.
Repeated rows get slots of their own, but lie in one arc, as do all rows of one doc_id. With no rows the result is empty. Texts
of any length count whole. Of other columns none is returned, so their names don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS, VIRTUAL = 24, 128
RING_BITS = 52


def ring_place(name: Column) -> Column:
    """52 bits of the name's MD5 as a number."""
    return F.conv(F.substring(F.md5(name), 1, RING_BITS // 4), 16, 10).cast("long")


def ring_points(shards: int = SHARDS, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    place = lambda s: int(hashlib.md5(s.encode()).hexdigest()[: RING_BITS // 4], 16)
    return sorted((place(f"shard-{s}-{v}"), s) for s in range(shards) for v in range(virtual))


def preference(points: list[tuple[int, int]], arc: int) -> list[int]:
    """All shards, in the order in which they are met clockwise from the arc's end."""
    return list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))


def stretches(points: list[tuple[int, int]], counts: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, first rank, rows, shard, first slot, home shard): where each arc's rows go.

    Round k offers what is left of each arc, in ring order, to the k-th shard clockwise of it; a full shard
    takes none. Capacities add up to the number of rows, so nothing is left after a round for each shard.
    """
    shards, n = sorted({s for _, s in points}), sum(counts)
    room = {s: n // len(shards) + (i < n % len(shards)) for i, s in enumerate(shards)}
    given, placed, out = [0] * len(points), dict.fromkeys(shards, 0), []
    order = [preference(points, arc) for arc in range(len(points))]
    for k in range(len(shards)):
        for arc, own in enumerate(order):
            take = min(counts[arc] - given[arc], room[own[k]])
            if take:
                out.append((arc, given[arc], take, own[k], placed[own[k]], own[0]))
                given[arc] += take
                placed[own[k]] += take
                room[own[k]] -= take
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard) for every row of (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    points = ring_points(shards, virtual)
    places = [p for p, _ in points]
    cells = 1 << (len(places) - 1).bit_length()
    width = (1 << RING_BITS) // cells
    cuts = [bisect_left(places, c * width) for c in range(cells + 1)]
    # the ring in equal cells: how many points lie before a cell, and those within it; its size is fixed by the parameters
    ring = spark.createDataFrame([(c, cuts[c], places[cuts[c] : cuts[c + 1]]) for c in range(cells)], "cell int, before int, inner array<bigint>")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = docs.select("doc_id", "text", ring_place(key).alias("place")).withColumn("cell", F.expr(f"CAST(place DIV {width} AS INT)"))
    passed = F.size(F.filter("inner", lambda p: p < F.col("place")))
    placed = placed.join(F.broadcast(ring), "cell").withColumn("arc", (F.col("before") + passed) % len(places))
    counts = [0] * len(points)
    for r in placed.groupBy("arc").count().collect():
        counts[r["arc"]] = r["count"]
    plan = stretches(points, counts)
    by_arc: dict[int, list] = {}
    for arc_no, first, rows, shard, slot, home in plan:
        by_arc.setdefault(arc_no, []).append((first, rows, shard, slot, home))
    table = spark.createDataFrame(
        [(a, v) for a, v in by_arc.items()],
        "arc int, goes array<struct<first:bigint,n:bigint,shard:int,slot:bigint,home:int>>",
    )
    text = F.coalesce("text", F.lit(""))
    rows = placed.select("doc_id", "arc", "place", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("place", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")) - 1
    ranked = rows.withColumn("rank", rank).join(F.broadcast(table), "arc")
    goes = F.element_at(F.filter("goes", lambda g: (g["first"] <= F.col("rank")) & (F.col("rank") < g["first"] + g["n"])), 1)
    ranked = ranked.withColumn("to", goes)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("to.shard").alias("shard"), (F.col("to.slot") + F.col("rank") - F.col("to.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("to.home").alias("home_shard")
    )

