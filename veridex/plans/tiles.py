"""Queries on pixels of tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import u_sql
from ..operators import resample as S
from ..operators import tiles as P
from .registry import Tables, query
from .selection import SEED

PX = ("pixels",)
RGB = ("r", "g", "b")
CELL_PX = 2
TOP, LOW = "greatest(r, g, b)", "least(r, g, b)"
TISSUE = f"({TOP} < 204 OR ({TOP} - {LOW}) * 100 > 8 * {TOP})"
LUMA = "((r * 299 + g * 587 + b * 114 + 500) // 1000)"
CELL = "((y // 2) * 4 + x // 2)"
REGION = "(image_id % 65535 + 1)"


def regions(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 65535 + 1).alias("mask"))


@query("i1_tissue_mask", f"SELECT image_id, count(*) FILTER ({TISSUE}) AS tissue_px FROM pixels GROUP BY 1", PX)
def _(t: Tables):
    return P.tissue_counts(t.tiles).select("image_id", "tissue_px")


@query("i2_gray_mask", f"SELECT image_id, count(*) FILTER ({LUMA} < 220) AS tissue_px FROM pixels GROUP BY 1", PX)
def _(t: Tables):
    return P.tissue_counts(t.tiles).select("image_id", F.col("gray_px").alias("tissue_px"))


_COVER = f"""SELECT image_id, {CELL} AS cell_idx, 100.0::DOUBLE * count(*) FILTER ({TISSUE}) / count(*) AS tissue_pct, 100.0::DOUBLE * count(*) FILTER ({LUMA} < 220) / count(*) AS gray_pct, avg({LUMA}) AS mean_gray,
    avg(CASE WHEN {TOP} > 0 THEN ({TOP} - {LOW})::DOUBLE / {TOP} ELSE 0 END) AS mean_saturation FROM pixels GROUP BY ALL"""


@query("i3_cell_coverage", f"SELECT image_id, substr('ABCD', 1 + cell_idx // 4, 1) || (cell_idx % 4 + 1) AS cell, tissue_pct, gray_pct, mean_gray, mean_saturation, tissue_pct < 5 AS is_empty, NOT (cell_idx // 4 IN (1, 2) AND cell_idx % 4 IN (1, 2)) AS touches_border FROM ({_COVER})", PX, ("mean_saturation",))
def _(t: Tables):
    return P.cell_coverage(t.tiles, CELL_PX).drop("cell_idx")


@query("i3_tile_coverage", f"""SELECT image_id, min(tissue_pct) AS min_cell_pct, max(tissue_pct) AS max_cell_pct, avg(tissue_pct) AS tile_tissue_pct, count(*) FILTER (tissue_pct < 5) AS n_empty,
    coalesce(string_agg(substr('ABCD', 1 + cell_idx // 4, 1) || (cell_idx % 4 + 1), ',' ORDER BY cell_idx) FILTER (tissue_pct < 5), '') AS empty_cells FROM ({_COVER}) GROUP BY 1""", PX, ("min_cell_pct", "max_cell_pct", "tile_tissue_pct"))
def _(t: Tables):
    return P.tile_coverage(P.cell_coverage(t.tiles, CELL_PX))


_LINE = "((x % 2 = 0 AND x > 0) OR (y % 2 = 0 AND y > 0))"


@query("i4_grid_overlay", f"SELECT image_id, 100.0::DOUBLE * count(*) FILTER ({_LINE}) / count(*) AS pct_of_tile, 100.0::DOUBLE * count(*) FILTER ({_LINE} AND {TISSUE}) / nullif(count(*) FILTER ({TISSUE}), 0) AS pct_of_tissue FROM pixels GROUP BY 1", PX, ("pct_of_tile", "pct_of_tissue"))
def _(t: Tables):
    return P.grid_overlay(t.tiles, CELL_PX)


_IN = f"({REGION} & (1::BIGINT << {CELL}::INT)) != 0"
_SUMS = "sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b"


@query("i5_mask_mean", f"""
    WITH m AS (SELECT image_id, round_even(avg(r), 0)::INT AS mr, round_even(avg(g), 0)::INT AS mg, round_even(avg(b), 0)::INT AS mb FROM pixels GROUP BY 1)
    SELECT image_id, sum(CASE WHEN {_IN} THEN mr ELSE r END)::BIGINT AS r, sum(CASE WHEN {_IN} THEN mg ELSE g END)::BIGINT AS g, sum(CASE WHEN {_IN} THEN mb ELSE b END)::BIGINT AS b FROM pixels JOIN m USING (image_id) GROUP BY 1""", PX)
def _(t: Tables):
    return P.channel_sums(P.masked(t.tiles, regions(t), "mean", CELL_PX))


@query("i6_mask_black", f"SELECT image_id, {_SUMS} FROM (SELECT image_id, CASE WHEN {_IN} THEN 0 ELSE r END AS r, CASE WHEN {_IN} THEN 0 ELSE g END AS g, CASE WHEN {_IN} THEN 0 ELSE b END AS b FROM pixels) GROUP BY 1", PX)
def _(t: Tables):
    return P.channel_sums(P.masked(t.tiles, regions(t), "black", CELL_PX))


#: Weights of smoothing 8 pixels with deviation 1, by the distance of the Gaussian's centre; edges are repeated.
_BLUR = ", ".join(f"({i}, {j}, {float(w)!r}::DOUBLE)" for i, row in enumerate(P._kernel(8, 1.0)) for j, w in enumerate(row))
_ACROSS, _DOWN = (", ".join(f"sum(w * {c}) AS {c}" for c in RGB) for _ in range(2))
_PASTED = ", ".join(f"sum(CASE WHEN {_IN} THEN greatest(0, least(255, round_even(v.{c}, 0)))::INT ELSE p.{c} END)::BIGINT AS {c}" for c in RGB)


@query("i7_mask_blur", f"""
    WITH k(i, j, w) AS (VALUES {_BLUR}), a AS (SELECT image_id, y, i AS x, {_ACROSS} FROM pixels JOIN k ON j = x GROUP BY ALL), v AS (SELECT image_id, i AS y, x, {_DOWN} FROM a JOIN k ON j = y GROUP BY ALL)
    SELECT image_id, {_PASTED} FROM pixels p JOIN v USING (image_id, y, x) GROUP BY 1""", PX)
def _(t: Tables):
    return P.channel_sums(P.masked(t.tiles, regions(t), P.blurred(1.0), CELL_PX))


@query("i8_region_mask", f"SELECT image_id, count(*) FILTER ({_IN}) AS region_px FROM pixels GROUP BY 1", PX)
def _(t: Tables):
    return P.region_counts(t.tiles, regions(t), CELL_PX)


@query("i9_mask_accounting", f"""
    SELECT image_id, {REGION} AS mask, bit_count({REGION})::BIGINT AS n_cells, 100.0::DOUBLE * count(*) FILTER ({_IN}) / count(*) AS pct_of_tile,
           100.0::DOUBLE * (count(*) FILTER ({_IN} AND {TISSUE})::DOUBLE / nullif(count(*) FILTER ({TISSUE}), 0)) AS pct_of_tissue FROM pixels GROUP BY image_id""", PX, ("pct_of_tile", "pct_of_tissue"))
def _(t: Tables):
    return P.mask_accounting(P.cell_sums(P.integrals(t.tiles), CELL_PX), regions(t))


_BOX = "y >= image_id % 5 + k - 1 AND y < image_id % 5 + k + 3 AND x >= k AND x < image_id % 7 + 2 * k"


@query("i9_box_accounting", f"""
    SELECT image_id, k, count(*) FILTER ({_BOX}) AS px, count(*) FILTER ({_BOX} AND {TISSUE}) AS tissue FROM pixels, (VALUES (0), (1), (2)) AS b(k) GROUP BY ALL""", PX)
def _(t: Tables):
    """Three boxes a tile, some empty, some beyond its border."""
    i, k = F.col("image_id"), F.col("k")
    boxes = t.orders.select(F.col("o_orderkey").alias("image_id"), F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("k"))
    boxes = boxes.select("image_id", "k", (i % 5 + k - 1).alias("y0"), k.alias("x0"), (i % 5 + k + 3).alias("y1"), (i % 7 + 2 * k).alias("x1"))
    found = P.box_sums(P.integrals(t.tiles), boxes.select("image_id", "y0", "x0", "y1", "x1"))
    return found.select("image_id", F.col("x0").alias("k"), "px", "tissue")


_OD = [f"-ln(({c} + 1) / 256.0::DOUBLE)" for c in RGB]
_STAIN = [" + ".join(f"({d}) * ({float(P._UNMIX[j, k])!r}::DOUBLE)" for j, d in enumerate(_OD)) for k in (0, 1)]


@query("i11_stain_channels", f"SELECT image_id, avg({_STAIN[0]}) AS hematoxylin, avg({_STAIN[1]}) AS eosin FROM pixels GROUP BY 1", PX, ("hematoxylin", "eosin"))
def _(t: Tables):
    return P.stain_means(t.tiles)


@query("i12_stain_zscores", f"""
    WITH c AS (SELECT *, {_STAIN[0]} AS h, {_STAIN[1]} AS e, {TISSUE} AS t FROM pixels), s AS (SELECT image_id, avg(h) AS mh, stddev_pop(h) AS sh, avg(e) AS me, stddev_pop(e) AS se FROM c WHERE t GROUP BY 1)
    SELECT image_id, count(*) FILTER (t) AS n_tissue, round(max(CASE WHEN sh > 0 THEN (h - mh) / sh ELSE 0 END), 6) AS top_h, round(min(CASE WHEN se > 0 THEN (e - me) / se ELSE 0 END), 6) AS low_e FROM c JOIN s USING (image_id) GROUP BY 1""", PX)
def _(t: Tables):
    z = P.stain_zscores(t.tiles)
    return z.select("image_id", "n_tissue", F.round(F.array_max("z_hematoxylin"), 6).alias("top_h"), F.round(F.array_min("z_eosin"), 6).alias("low_e"))


@query("i12_stain_partition")
def _(t: Tables):
    return P.stain_partition(t.tiles, 0.5, 2).select("image_id", "epithelium_px", "stroma_px")


@query("i13_structure_accounting", f"""
    SELECT image_id, count(*) FILTER (r > 180) AS mask_px, 100.0::DOUBLE * count(*) FILTER (r > 180) / count(*) AS pct_of_tile, 100.0::DOUBLE * count(*) FILTER (r > 180 AND {TISSUE}) / nullif(count(*) FILTER ({TISSUE}), 0) AS pct_of_tissue,
           count(*) FILTER (g > 120) AS control_px, 100.0::DOUBLE * count(*) FILTER (r > 180 AND g > 120) / nullif(count(*) FILTER (g > 120), 0) AS overlap_pct_of_control FROM pixels GROUP BY 1""", PX, ("pct_of_tile", "pct_of_tissue", "overlap_pct_of_control"))
def _(t: Tables):
    return P.structure_accounting(P.with_masks(t.tiles, s=lambda rgb: rgb[..., 0] > 180, c=lambda rgb: rgb[..., 1] > 120), "s", "c")


@query("i14_dilate", f"""
    WITH d AS (SELECT DISTINCT image_id, y + i AS y, x + j AS x FROM pixels, (VALUES (-1), (0), (1)) AS a(i), (VALUES (-1), (0), (1)) AS c(j) WHERE r > 225 AND r < 240)
    SELECT image_id, count(*) AS n FROM pixels JOIN d USING (image_id, y, x) WHERE {TISSUE} GROUP BY 1""", PX)
def _(t: Tables):
    rows = P.with_masks(t.tiles, m=lambda rgb: (rgb[..., 0] > 225) & (rgb[..., 0] < 240))
    return P.dilate(rows, "m").select("image_id", "n").where("n > 0")


@query("i15_macenko")
def _(t: Tables):
    return P.channel_sums(P.macenko_normalize(t.tiles))


@query("i16_normalization_failed", "SELECT image_id, avg(v) AS mean, stddev_pop(v) AS sd, avg(v) < 5 OR avg(v) > 250 OR stddev_pop(v) < 2 AS failed FROM (SELECT image_id, unnest([r, g, b]) AS v FROM pixels) GROUP BY 1", PX, ("mean", "sd"))
def _(t: Tables):
    return P.normalization_failed(t.tiles)


@query("h11_block_shuffle", f"""
    WITH k AS (SELECT image_id, {CELL} AS block, count(*) FILTER (r > 180) AS masked, count(*) FILTER ({TISSUE})::DOUBLE / count(*) AS share FROM pixels GROUP BY ALL),
    s AS (SELECT image_id, block AS moved_from, masked, row_number() OVER (PARTITION BY image_id ORDER BY block) AS rk FROM k WHERE masked > 0),
    o AS (SELECT image_id, block AS moved_to, row_number() OVER (PARTITION BY image_id ORDER BY {u_sql(SEED, 'image_id', 'block')}, block) AS rk FROM k WHERE share > 0.3)
    SELECT image_id, moved_from, moved_to, masked, moved_to IS NULL AS lost FROM s LEFT JOIN o USING (image_id, rk)""", PX)
def _(t: Tables):
    return S.block_shuffle(P.blocks(P.with_masks(t.tiles, m=lambda rgb: rgb[..., 0] > 180), "m", CELL_PX), SEED)
