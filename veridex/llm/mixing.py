"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share as many words as all documents have. A source
gives each of its words at most `most` times; what it can't give is shared by weight among the others (water filling:
every source's target is weight * level or its own bound). Of its target a source first gives complete epochs: every
document once an epoch. The fraction that is left goes to documents in the order of exponential keys -ln(u) / quality,
up to the document that crosses the budget, which is taken if more than half of it fits.

u comes from an MD5 of seed and doc_id, so reruns agree whatever the partitioning. Keys map to places in (0, 1), which are
cut into equal cells; sums by source and cell tell in which cell the budget ends. Documents of other cells are decided
by their cell alone, and only those of that cell are sorted: a window holds a 4096th of one source. Sources with many
documents meet their plan by a broadcast of at most heat.MOST rows. DataFrame functions do everything.

Nulls: a null text has size 0, a null source is a source of its own, a null doc_id draws like the empty string, and a document
without quality, or with one that isn't positive, weighs 1 or LEAST. Repeated rows each count; rows of one doc_id share
a key, and lie in one task if the budget ends there. Documents without words take nothing, an empty table gives an empty
result. Texts count whole. Of other columns none is returned, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import heat
from .store import written

RATIO, MOST, SEED = (5, 2, 1), 3, 42
CELLS = 4096
#: The least quality that a document counts with.
LEAST = 1e-6
BLANKS = " \t\n\x0b\x0c\r"
DIGITS = 13  # of the MD5: 52 bits


def word_count(text: Column) -> Column:
    """Number of runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(marks, BLANKS, "")).cast("long")


def exponential_key(quality: Column, seed: int = SEED) -> Column:
    """-ln(u) / quality with u in (0, 1) from seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.md5(name), 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return -F.ln(u) / quality


def _sized(docs: DataFrame, quality: DataFrame | None, seed: int) -> DataFrame:
    """(doc_id, skey, source, size, key, cell), a narrow row a document."""
    rows = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("skey"), word_count(F.col("text")).alias("size"))
    weight: Column = F.lit(1.0)
    if quality is not None:
        one = quality.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
        rows = rows.join(one, "doc_id", "left")
        weight = F.greatest(F.coalesce("quality", F.lit(1.0)), F.lit(LEAST))
    rows = rows.withColumn("key", exponential_key(weight, seed))
    return rows.select("doc_id", "skey", "source", "size", "key", F.least(F.floor((1 - F.exp(-F.col("key"))) * CELLS), F.lit(CELLS - 1)).cast("int").alias("cell"))


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with `position`, counted from 0 in code point order, null last; no task holds more than a range of them."""
    ranged = written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # a row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    table = sources.sparkSession.createDataFrame(offsets, "part int, before long")
    return ranged.withColumn("rank", rank).join(F.broadcast(table), "part").withColumn("position", F.col("rank") + F.col("before")).drop("part", "rank", "before")


def level(sources: DataFrame, total: int, most: int = MOST) -> float:
    """The level at which min(weight * level, most * source_size) adds up to total; every pass adds sources that are full."""
    cap, found = F.col("source_size") * most, 0.0
    full = lambda at: cap < F.col("weight") * F.lit(at)
    while True:
        held, open_weight = sources.agg(F.coalesce(F.sum(F.when(full(found), cap)), F.lit(0)), F.sum(F.when(~full(found), F.col("weight")))).first()
        if not open_weight:
            return found
        higher = (total - held) / open_weight
        if higher <= found:
            return found
        found = higher


def targets(sources: DataFrame, ratio: tuple[int, ...] = RATIO, most: int = MOST) -> DataFrame:
    """sources (source, source_size, ...) with weight and target."""
    weight = F.element_at(F.array(*[F.lit(r).cast("long") for r in ratio]), (F.col("position") % len(ratio) + 1).cast("int"))
    weighed = written(_numbered(sources).withColumn("weight", weight), "weighed")
    at = level(weighed, weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], most)
    bound, wanted = (F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(at)
    return weighed.withColumn("target", F.when(bound < wanted, bound).otherwise(wanted))


def mix(docs: DataFrame, quality: DataFrame | None = None, ratio: tuple[int, ...] = RATIO, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    quality: (doc_id, quality), the weights of documents within their source; several rows of a doc_id count with their mean.
    """
    rows = written(_sized(docs, quality, seed), "sized")
    sources = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sources, ratio, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    cells = rows.groupBy("skey", "cell").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = cells.withColumn("before", before).join(plan.select("skey", "rest"), "skey")
    edge = summed.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("held"))).select("skey", F.col("cell").alias("edge"), "before")
    plan = written(plan.select("skey", "source_size", "target", "epochs", "rest", "n").join(edge, "skey", "left"), "plan")
    hot = heat.hot_keys(plan, ["skey"], plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    planned = heat.attached(rows, plan.drop("n"), ["skey"], hot)
    at_edge = F.col("cell") == F.col("edge")
    order = Window.partitionBy("skey").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = planned.where(at_edge).withColumn("more", (ahead + F.col("size") / 2 <= F.col("rest")).cast("long"))
    # without an edge the fraction is empty
    rest = planned.where(~F.coalesce(at_edge, F.lit(False))).withColumn("more", F.coalesce(F.col("cell") < F.col("edge"), F.lit(False)).cast("long"))
    both = cut.unionByName(rest)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken"))


#: The same in DuckDB over documents and labels, whose quality 1 weighs 2 and 0 weighs 0.5.
SQL = rf"""
    WITH l AS (SELECT doc_id, avg(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    d AS (SELECT d.doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, greatest(coalesce(q, 1.0::DOUBLE), {LEAST}) AS q,
                 (('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, {DIGITS}))::BIGINT + 0.5::DOUBLE) / {16**DIGITS}.0::DOUBLE AS u FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY 1),
    w AS (SELECT source, source_size, CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
    p AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
          FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
    v AS (SELECT coalesce(max((total - held)::DOUBLE / open_weight::DOUBLE) FILTER (cap >= weight * ((total - held)::DOUBLE / open_weight::DOUBLE)), 0) AS lev FROM p),
    t AS (SELECT source, source_size, CASE WHEN cap::DOUBLE < weight * lev THEN cap::DOUBLE ELSE weight * lev END AS target FROM w, v),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
    a AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
          FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (epochs + CASE WHEN ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM a
"""
