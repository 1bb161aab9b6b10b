"""Tiles as packed rows (image_id, height, width, rgb): tissue rules, coverage, masks, stains, matched areas.

rgb holds a tile's bytes row by row, three a pixel. Operators stack the tiles of a batch that have one shape into arrays
(tiles x height x width x 3), at most STACK pixels at a time, and work on whole stacks; pixels are never rows and no tile is
shuffled. Masks of pixels are columns of packed bits. Tiles without bytes (null rgb, see sources.files.read_tiles) have no results.
Sums over boxes and cells come from summed-area tables, so any number of regions costs no pass over pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CELLS, bit, cell_name

SIDE = 4  # cells a side
STACK = 1 << 17
Stack = np.ndarray
Rule = Callable[[Stack], np.ndarray]
TILE = "image_id long, height int, width int, rgb binary"


# --- stacks ---


def _bytes(column: pa.Array, each: int) -> np.ndarray:
    """Rows of a binary column of `each` bytes a row, without a copy where they lie together."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8, count=int(at[-1]))[at[0] :].reshape(len(column), each)


def stacks(batches: Iterator[pa.RecordBatch], pixels: int = STACK) -> Iterator[tuple[Stack, pa.Table]]:
    """(rgb, rows): tiles of one shape, n x height x width x 3, with all their columns; memory holds a batch and one stack."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.filter(pa.compute.is_valid(table["rgb"]))
        h, w = (table[c].to_numpy().astype(np.int64) for c in ("height", "width"))
        for shape in np.unique(np.stack([h, w], axis=1), axis=0):
            height, width = map(int, shape)
            same = table.filter(pa.array((h == height) & (w == width)))
            step = max(1, pixels // max(1, height * width))
            for i in range(0, same.num_rows, step):
                part = same.slice(i, step).combine_chunks()
                yield _bytes(part["rgb"].combine_chunks(), height * width * 3).reshape(-1, height, width, 3), part


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows' bytes."""
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * rows.shape[1]
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(rows)])
    return pa.array([r.tobytes() for r in rows], pa.binary())


def mapped(tiles: DataFrame, kernel: Callable[[Stack, pa.Table], dict[str, np.ndarray | pa.Array]], schema: str, keep: tuple[str, ...] = ("image_id",), each: int = 1) -> DataFrame:
    """kernel on every stack. It returns columns of `each` rows a tile, beside which the tile's keep columns are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rgb, rows in stacks(batches):
            found = kernel(rgb, rows)
            again = np.repeat(np.arange(len(rgb)), each)
            columns = {c: rows[c].combine_chunks().take(pa.array(again)) if each > 1 else rows[c].combine_chunks() for c in keep}
            columns |= {k: v if isinstance(v, pa.Array) else pa.array(v.reshape(-1)) for k, v in found.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in keep)
    return tiles.mapInArrow(run, f"{kept}, {schema}" if keep else schema)


def with_bytes(tiles: DataFrame, kernel: Callable[[Stack, pa.Table], Stack]) -> DataFrame:
    """(image_id, height, width, rgb) with other bytes."""
    return mapped(tiles, lambda rgb, rows: {"rgb": _binary(kernel(rgb, rows).astype(np.uint8))}, "rgb binary", ("image_id", "height", "width"))


def with_masks(tiles: DataFrame, **rules: Rule) -> DataFrame:
    """tiles with a column of packed bits for each rule."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        return {name: pack(rule(rgb)) for name, rule in rules.items()}

    return mapped(tiles, kernel, ", ".join(f"{name} binary" for name in rules), tuple(tiles.columns))


def pack(mask: np.ndarray) -> pa.Array:
    return _binary(np.packbits(mask.reshape(len(mask), -1), axis=1))


def unpack(rows: pa.Table, name: str, shape: tuple[int, ...]) -> np.ndarray:
    """The masks of a column of packed bits, for a stack of that shape."""
    n, height, width = shape[:3]
    packed = _bytes(rows[name].combine_chunks(), -(-height * width // 8))
    return np.unpackbits(packed, axis=1, count=height * width).reshape(n, height, width).astype(bool)


# --- rules ---


def _top(rgb: Stack) -> np.ndarray:
    return np.maximum(np.maximum(rgb[..., 0], rgb[..., 1]), rgb[..., 2])


def _low(rgb: Stack) -> np.ndarray:
    return np.minimum(np.minimum(rgb[..., 0], rgb[..., 1]), rgb[..., 2])


def is_tissue(rgb: Stack) -> np.ndarray:
    """Saturation above 0.08 or brightness below 0.8, decided in whole numbers."""
    top = _top(rgb)
    return (top < 204) | ((top - _low(rgb)).astype(np.uint16) * 100 > top.astype(np.uint16) * 8)


def luma(rgb: Stack) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.int32) for k in range(3))
    return (r * 299 + g * 587 + b * 114 + 500) // 1000


def is_gray_tissue(rgb: Stack) -> np.ndarray:
    return luma(rgb) < 220


def saturation(rgb: Stack) -> np.ndarray:
    top = _top(rgb)
    return np.where(top > 0, (top - _low(rgb)) / np.maximum(top, 1), 0.0)


def cells_of(height: int, width: int, cell_px: int) -> np.ndarray:
    """The cell of each pixel."""
    if height > SIDE * cell_px or width > SIDE * cell_px:
        raise ValueError(f"a tile of {height} x {width} pixels has more than {SIDE} x {SIDE} cells of {cell_px}")
    return np.arange(height)[:, None] // cell_px * SIDE + np.arange(width)[None, :] // cell_px


def by_cell(values: np.ndarray, cell_px: int) -> np.ndarray:
    """Sums of n x height x width over the 16 cells, n x 16 (0 for cells outside the tile)."""
    _, height, width = values.shape
    cells_of(height, width, cell_px)
    kind = np.float64 if values.dtype.kind == "f" else np.int32
    rows = np.add.reduceat(values, np.arange(0, height, cell_px), axis=1, dtype=kind)
    sums = np.add.reduceat(rows, np.arange(0, width, cell_px), axis=2, dtype=kind)
    out = np.zeros((len(values), SIDE, SIDE), dtype=kind)
    out[:, : sums.shape[1], : sums.shape[2]] = sums
    return out.reshape(len(values), CELLS)


def _sum(mask: np.ndarray) -> np.ndarray:
    return mask.reshape(len(mask), -1).sum(axis=1, dtype=np.int64)


# --- coverage ---


def tissue_counts(tiles: DataFrame) -> DataFrame:
    """(image_id, px, tissue_px, gray_px): pixels, and those that are tissue by either rule."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        px = np.full(len(rgb), rgb.shape[1] * rgb.shape[2], dtype=np.int64)
        return {"px": px, "tissue_px": _sum(is_tissue(rgb)), "gray_px": _sum(is_gray_tissue(rgb))}

    return mapped(tiles, kernel, "px long, tissue_px long, gray_px long")


def cell_coverage(tiles: DataFrame, cell_px: int, empty_below: float = 5.0) -> DataFrame:
    """Per cell: shares of tissue by both rules, mean gray and saturation; emptiness goes by the unrounded share."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        gray = luma(rgb)
        px = np.bincount(cells_of(*rgb.shape[1:3], cell_px).reshape(-1), minlength=CELLS)
        n = np.broadcast_to(px, (len(rgb), CELLS))
        measured = {"tissue_px": is_tissue(rgb), "gray_px": gray < 220, "gray": gray, "saturation": saturation(rgb)}
        return {"cell_idx": np.tile(np.arange(CELLS, dtype=np.int32), len(rgb)), "px": n.astype(np.int32)} | {k: by_cell(v, cell_px) for k, v in measured.items()}

    sums = mapped(tiles, kernel, "cell_idx int, px int, tissue_px int, gray_px int, gray int, saturation double", each=CELLS).where("px > 0")
    i, n = F.col("cell_idx"), F.col("px")
    inner = (i / SIDE).cast("int").isin(1, 2) & (i % SIDE).isin(1, 2)
    pct = lambda c: 100.0 * F.col(c) / n
    return sums.select(
        "image_id", "cell_idx", pct("tissue_px").alias("tissue_pct"), pct("gray_px").alias("gray_pct"), (F.col("gray") / n).alias("mean_gray"), (F.col("saturation") / n).alias("mean_saturation"),
        cell_name("cell_idx").alias("cell"), (pct("tissue_px") < empty_below).alias("is_empty"), (~inner).alias("touches_border"),
    )


def tile_coverage(cells: DataFrame) -> DataFrame:
    """Per tile: least and most covered cell, mean, and the empty cells."""
    empty = F.sort_array(F.collect_list(F.when(F.col("is_empty"), F.col("cell"))))
    return cells.groupBy("image_id").agg(F.min("tissue_pct").alias("min_cell_pct"), F.max("tissue_pct").alias("max_cell_pct"), F.avg("tissue_pct").alias("tile_tissue_pct"), F.count_if("is_empty").alias("n_empty"), F.array_join(empty, ",").alias("empty_cells"))


def grid_overlay(tiles: DataFrame, cell_px: int) -> DataFrame:
    """Shares of the tile, and of its tissue, that lines at inner cell borders change."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        on = lambda n: (np.arange(n) % cell_px == 0) & (np.arange(n) > 0)
        line = on(rgb.shape[1])[:, None] | on(rgb.shape[2])[None, :]
        tissue = is_tissue(rgb)
        return {"line_px": np.full(len(rgb), line.sum()), "px": np.full(len(rgb), line.size), "line_tissue": _sum(tissue & line), "tissue": _sum(tissue)}

    n = mapped(tiles, kernel, "line_px long, px long, line_tissue long, tissue long")
    return n.select("image_id", (100.0 * F.col("line_px") / F.col("px")).alias("pct_of_tile"), F.try_divide(100.0 * F.col("line_tissue"), F.col("tissue")).alias("pct_of_tissue"))


# --- summed-area tables ---

#: What is summed by default.
MEASURES: dict[str, Rule] = {"px": lambda rgb: np.ones(rgb.shape[:3], dtype=bool), "tissue": is_tissue}


def integrals(tiles: DataFrame, **rules: Rule) -> DataFrame:
    """(image_id, height, width, a column a rule): tables of 32-bit sums, (height + 1) x (width + 1), of all boxes from the upper left."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        out = {}
        for name, rule in (rules or MEASURES).items():
            table = np.zeros((len(rgb), rgb.shape[1] + 1, rgb.shape[2] + 1), dtype=np.int32)
            table[:, 1:, 1:] = rule(rgb).cumsum(axis=1, dtype=np.int32).cumsum(axis=2, dtype=np.int32)
            out[name] = _binary(table)
        return out

    return mapped(tiles, kernel, ", ".join(f"`{k}` binary" for k in (rules or MEASURES)), ("image_id", "height", "width"))


def _tables(column: pa.Array, height: int, width: int) -> np.ndarray:
    return _bytes(column, 4 * (height + 1) * (width + 1)).view(np.int32).reshape(-1, height + 1, width + 1)


def _shapes(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, int, int]]:
    table = pa.Table.from_batches([batch])
    h, w = (table[c].to_numpy() for c in ("height", "width"))
    for height, width in np.unique(np.stack([h, w], axis=1), axis=0).tolist() if len(h) else ():
        yield table.filter(pa.array((h == height) & (w == width))), height, width


def cell_sums(tables: DataFrame, cell_px: int) -> DataFrame:
    """(image_id, an array of 16 sums a measure): four reads of its table a cell."""
    names = [c for c in tables.columns if c not in ("image_id", "height", "width")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, height, width in _shapes(batch):
                cells_of(height, width, cell_px)
                y, x = (np.minimum(np.arange(SIDE + 1) * cell_px, n) for n in (height, width))
                arrays = []
                for name in names:
                    at = _tables(rows[name].combine_chunks(), height, width)[:, y][:, :, x]
                    sums = np.diff(np.diff(at, axis=1), axis=2).reshape(-1).astype(np.int64)
                    arrays.append(pa.FixedSizeListArray.from_arrays(pa.array(sums), CELLS).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([rows["image_id"].combine_chunks(), *arrays], names=["image_id", *names])

    return tables.mapInArrow(run, f"image_id {tables.schema['image_id'].dataType.simpleString()}, " + ", ".join(f"`{n}` array<long>" for n in names))


#: Boxes of one tile that are summed at once.
BOXES = 4096


def box_sums(tables: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes (image_id, y0, x0, y1, x1; the ends outside) with the sum of each measure, by four reads of its table a box.

    Boxes are cut to the tile; those of unknown tiles are left out. A tile's boxes meet its table in blocks of BOXES.
    """
    names = [c for c in tables.columns if c not in ("image_id", "height", "width")]
    ends = ["y0", "x0", "y1", "x1"]
    box = F.struct(*[F.col(c).cast("int").alias(c) for c in ends])
    # merge: Spark takes the size of packed columns from the scanned ones, and would send a large side through the driver
    counted = boxes.groupBy("image_id").agg(F.count("*").alias("_n")).hint("merge")
    block = F.pmod(F.xxhash64(*ends), F.ceil(F.col("_n") / BOXES))
    blocks = boxes.join(counted, "image_id").groupBy("image_id", block.alias("_block")).agg(F.collect_list(box).alias("boxes"))
    met = blocks.join(tables.hint("merge"), "image_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, height, width in _shapes(batch):
                lists = rows["boxes"].combine_chunks()
                n = pa.compute.list_value_length(lists).to_numpy()
                at, flat = np.repeat(np.arange(len(n)), n), lists.flatten()
                given = [flat.field(c).to_numpy() for c in ends]
                y0, x0, y1, x1 = (np.clip(v, 0, m) for v, m in zip(given, (height, width, height, width), strict=True))
                y1, x1 = np.maximum(y0, y1), np.maximum(x0, x1)
                sums = []
                for name in names:
                    t = _tables(rows[name].combine_chunks(), height, width)
                    sums.append(pa.array((t[at, y1, x1].astype(np.int64) - t[at, y0, x1] - t[at, y1, x0] + t[at, y0, x0])))
                yield pa.RecordBatch.from_arrays([rows["image_id"].combine_chunks().take(pa.array(at)), *[pa.array(v) for v in given], *sums], names=["image_id", *ends, *names])

    kind = tables.schema["image_id"].dataType.simpleString()
    return met.select("image_id", "boxes", "height", "width", *names).mapInArrow(run, f"image_id {kind}, y0 int, x0 int, y1 int, x1 int, " + ", ".join(f"`{n}` long" for n in names))


def mask_accounting(sums: DataFrame, regions: DataFrame) -> DataFrame:
    """Per tile and set of cells: cells, and shares of the tile and of its tissue. sums: see cell_sums; sets meet 16 numbers a tile."""
    inside = lambda c: F.aggregate(F.transform(c, lambda v, i: F.when(F.col("mask").bitwiseAND(bit(i)) != 0, v).otherwise(0)), F.lit(0).cast("long"), lambda s, v: s + v)
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    pct = lambda c: 100.0 * F.try_divide(inside(c), whole(c))
    return regions.join(sums.hint("merge"), "image_id").select("image_id", "mask", F.bit_count("mask").cast("long").alias("n_cells"), pct("px").alias("pct_of_tile"), pct("tissue").alias("pct_of_tissue"))


# --- masked tiles ---


def _inside(rgb: Stack, rows: pa.Table, cell_px: int) -> np.ndarray:
    """The pixels of each tile's set of cells (column mask)."""
    return (rows["mask"].to_numpy()[:, None, None] >> cells_of(*rgb.shape[1:3], cell_px)[None]) & 1 == 1


@lru_cache
def _kernel(n: int, sigma: float) -> np.ndarray:
    """n x n weights of Gaussian smoothing in one dimension, with edges repeated."""
    radius = max(1, int(4 * sigma + 0.5))
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-(offsets**2) / (2 * sigma**2))
    out = np.zeros((n, n))
    for i in range(n):
        np.add.at(out[i], np.clip(i + offsets, 0, n - 1), weights / weights.sum())
    return out


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian smoothing of the last two axes."""
    return _kernel(a.shape[-2], sigma) @ a @ _kernel(a.shape[-1], sigma).T


def mean_colour(rgb: Stack, inside: np.ndarray) -> Stack:
    """The region in the tile's mean colour, rounded half to even."""
    mean = np.rint(rgb.reshape(len(rgb), -1, 3).mean(axis=1))[:, None, None, :]
    return np.where(inside[..., None], mean, rgb)


def black(rgb: Stack, inside: np.ndarray) -> Stack:
    return np.where(inside[..., None], 0, rgb)


def blurred(sigma: float) -> Callable[[Stack, np.ndarray], Stack]:
    """The region blurred: the whole tile is smoothed and pasted into the region."""

    def mask(rgb: Stack, inside: np.ndarray) -> Stack:
        smooth = np.moveaxis(gaussian(np.moveaxis(rgb, 3, 1).astype(float), sigma), 1, 3)
        return np.where(inside[..., None], np.clip(np.rint(smooth), 0, 255), rgb)

    return mask


#: Maskers by name: a stack and the pixels of its regions to a stack.
MASKERS: dict[str, Callable[[Stack, np.ndarray], Stack]] = {"mean": mean_colour, "black": black, "blur": blurred(12.0)}


def masked(tiles: DataFrame, regions: DataFrame, masker: str | Callable[[Stack, np.ndarray], Stack], cell_px: int) -> DataFrame:
    """tiles with the set of cells of regions (image_id, mask) changed by a masker."""
    change = MASKERS[masker] if isinstance(masker, str) else masker
    return with_bytes(tiles.join(regions.hint("merge"), "image_id"), lambda rgb, rows: change(rgb, _inside(rgb, rows, cell_px)))


def region_counts(tiles: DataFrame, regions: DataFrame, cell_px: int) -> DataFrame:
    """(image_id, region_px)"""
    return mapped(tiles.join(regions.hint("merge"), "image_id"), lambda rgb, rows: {"region_px": _sum(_inside(rgb, rows, cell_px))}, "region_px long")


def channel_sums(tiles: DataFrame) -> DataFrame:
    """(image_id, r, g, b): sums over the tile."""
    return mapped(tiles, lambda rgb, rows: {c: _sum(rgb[..., k]) for k, c in enumerate("rgb")}, "r long, g long, b long")


def match_quality(df: DataFrame, treated: str, control: str, most: float = 5.0) -> DataFrame:
    """Gap in points of the rounded shares; usable when it is small and the sets don't overlap."""
    gap = F.round(F.round(treated, 1) - F.round(control, 1), 1)
    small, apart = F.abs(gap) <= most, F.col("overlap") == 0
    reason = F.when(small & apart, "ok").when(~small & apart, "gap").when(small, "overlap").otherwise("gap and overlap")
    return df.withColumns({"gap": gap, "usable": F.coalesce(small & apart, F.lit(False)), "reason": F.coalesce(reason, F.lit("no control"))})


# --- stains ---

# Stain vectors of Ruifrok and Johnston (haematoxylin, eosin, residual), in rows.
STAINS = np.array([[0.650, 0.704, 0.286], [0.072, 0.990, 0.105], [0.268, 0.570, 0.776]])
_UNMIX = np.linalg.inv(STAINS / np.linalg.norm(STAINS, axis=1, keepdims=True))
_DENSITY = -np.log((np.arange(256) + 1) / 256)
CHANNELS = ("hematoxylin", "eosin")


def stains(rgb: Stack) -> tuple[np.ndarray, np.ndarray]:
    """Optical densities of haematoxylin and eosin of each pixel."""
    parts = [[(_DENSITY * _UNMIX[j, k])[rgb[..., j]] for j in range(3)] for k in (0, 1)]
    return tuple(p[0] + p[1] + p[2] for p in parts)


def stain_means(tiles: DataFrame) -> DataFrame:
    """(image_id, hematoxylin, eosin): mean densities."""
    return mapped(tiles, lambda rgb, rows: {c: v.reshape(len(rgb), -1).mean(axis=1) for c, v in zip(CHANNELS, stains(rgb), strict=True)}, "hematoxylin double, eosin double")


def _scaled(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Values by their mean and population deviation over `where`, tile by tile; 0 without deviation."""
    n = np.maximum(where.sum(axis=(1, 2), keepdims=True), 1)
    mean = (values * where).sum(axis=(1, 2), keepdims=True) / n
    sd = np.sqrt((np.square(values - mean) * where).sum(axis=(1, 2), keepdims=True) / n)
    # equal values have no deviation, whatever their mean rounds to
    fair = sd > 1e-12 * np.maximum(np.abs(mean), 1e-300)
    return np.where(fair, (values - mean) / np.where(fair, sd, 1), 0.0)


def stain_zscores(tiles: DataFrame) -> DataFrame:
    """(image_id, n_tissue, z_hematoxylin, z_eosin) of tiles with tissue: channels scaled over the tissue, an array a tile."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        tissue = is_tissue(rgb)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(_scaled(v, tissue).reshape(-1)), tissue[0].size).cast(pa.list_(pa.float64())) for v in stains(rgb)]
        return {"n_tissue": _sum(tissue), "z_hematoxylin": arrays[0], "z_eosin": arrays[1]}

    return mapped(tiles, kernel, "n_tissue long, z_hematoxylin array<double>, z_eosin array<double>").where("n_tissue > 0")


def _near(mask: np.ndarray, fill: bool) -> np.ndarray:
    """The 3 x 3 neighbours of each pixel, stacked first; outside the tile they are fill."""
    p = np.pad(mask, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    return np.stack([p[:, i : i + mask.shape[1], j : j + mask.shape[2]] for i in range(3) for j in range(3)])


def opened(mask: np.ndarray) -> np.ndarray:
    """3 x 3 erosion, then dilation, of masks n x height x width."""
    return _near(_near(mask, False).all(axis=0), False).any(axis=0)


def runs_and_parts(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, part) of all horizontal runs of masks n x height x width, by flat index: part is a run's 4-connected part.

    Runs that overlap in neighbouring rows are linked; roots hook to smaller neighbouring ones and paths are halved until they end, so
    rounds go with the logarithm of the number of runs, not with a part's diameter.
    """
    n, height, width = mask.shape
    rows = np.zeros((n * height, width + 2), dtype=np.int8)
    rows[:, 1:-1] = mask.reshape(n * height, width)
    edge = np.diff(rows, axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    span = width + 1
    first, last = row * span + start, row * span + end
    # runs of the next row that begin before this one's end and end after its start
    low, high = np.searchsorted(last, first + span, side="right"), np.searchsorted(first, last + span, side="left")
    links = np.where(row % height < height - 1, np.maximum(high - low, 0), 0)
    a = np.repeat(np.arange(len(row)), links)
    b = np.repeat(low - (np.cumsum(links) - links), links) + np.arange(len(a))
    part = np.arange(len(row))
    while len(a):
        x, y = part[a], part[b]
        open_ = x != y
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(part, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(shorter := part[part], part):
            part = shorter
    at = row * width
    return at + start, at + end, part


def without_blobs(mask: np.ndarray, least: int) -> np.ndarray:
    """Masks n x height x width without 4-connected parts of fewer than `least` pixels."""
    start, end, part = runs_and_parts(mask)
    if not len(part):
        return mask
    size = np.bincount(part, weights=end - start, minlength=len(part))
    kept = size[part] >= least
    flat = np.zeros(mask.size + 1, dtype=np.int8)
    flat[start[kept]] += 1
    np.subtract.at(flat, end[kept], 1)
    return np.cumsum(flat[:-1], dtype=np.int8).reshape(mask.shape) > 0


def stain_partition(tiles: DataFrame, sigma: float = 2.0, least_blob: int = 30) -> DataFrame:
    """tiles with masks: tissue as epithelium, where smoothed and scaled haematoxylin dominates, and stroma; both opened and without small parts."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        epithelium, stroma = partition(rgb, sigma, least_blob)
        return {"epithelium": pack(epithelium), "stroma": pack(stroma), "epithelium_px": _sum(epithelium), "stroma_px": _sum(stroma)}

    return mapped(tiles, kernel, "epithelium binary, stroma binary, epithelium_px long, stroma_px long", ("image_id", "height", "width", "rgb"))


def partition(rgb: Stack, sigma: float, least_blob: int) -> tuple[np.ndarray, np.ndarray]:
    tissue = is_tissue(rgb)
    z = [_scaled(gaussian(v, sigma), tissue) for v in stains(rgb)]
    epithelium = tissue & (z[0] > z[1])
    clean = lambda m: without_blobs(opened(m), least_blob)
    return clean(epithelium), clean(tissue & ~epithelium)


# --- structures ---


def structure_accounting(tiles: DataFrame, struct: str, control: str) -> DataFrame:
    """Pixels of a structure and its control (columns of packed bits), shares of tile and tissue, and their overlap."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        s, c, t = unpack(rows, struct, rgb.shape), unpack(rows, control, rgb.shape), is_tissue(rgb)
        return {"mask_px": _sum(s), "px": np.full(len(rgb), t[0].size), "on_tissue": _sum(s & t), "tissue": _sum(t), "control_px": _sum(c), "both": _sum(c & s)}

    n = mapped(tiles, kernel, "mask_px long, px long, on_tissue long, tissue long, control_px long, both long")
    pct = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return n.select("image_id", "mask_px", pct("mask_px", "px").alias("pct_of_tile"), pct("on_tissue", "tissue").alias("pct_of_tissue"), "control_px", pct("both", "control_px").alias("overlap_pct_of_control"))


def dilate(tiles: DataFrame, mask: str) -> DataFrame:
    """tiles with `dilated`: tissue within one pixel of the mask, and its size n."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        out = _near(unpack(rows, mask, rgb.shape), False).any(axis=0) & is_tissue(rgb)
        return {"dilated": pack(out), "n": _sum(out)}

    return mapped(tiles, kernel, "dilated binary, n long", ("image_id", "height", "width", "rgb"))


def blocks(tiles: DataFrame, mask: str, cell_px: int) -> DataFrame:
    """(image_id, block, masked, tissue_share): what each cell holds of a mask and of tissue."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        px = np.bincount(cells_of(*rgb.shape[1:3], cell_px).reshape(-1), minlength=CELLS)
        share = by_cell(is_tissue(rgb), cell_px) / np.maximum(px, 1)
        return {"block": np.tile(np.arange(CELLS, dtype=np.int32), len(rgb)), "masked": by_cell(unpack(rows, mask, rgb.shape), cell_px).astype(np.int64), "tissue_share": share}

    return mapped(tiles, kernel, "block int, masked long, tissue_share double", each=CELLS)


# --- normalisation ---

# Target stains of the normalisation (haematoxylin, eosin; rows r, g, b) and their densities.
TARGET_STAINS = np.array([[0.650, 0.072], [0.704, 0.990], [0.286, 0.105]])
TARGET_DENSITY = np.array([1.9705, 1.0308])


def _percentile(values: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """The q-th percentile of the first n values of each row, which are sorted."""
    at = q / 100 * (n - 1)
    low = np.floor(at).astype(np.int64)
    row = np.arange(len(n))
    a, b = values[row, low], values[row, np.minimum(low + 1, n - 1)]
    return a + (b - a) * (at - low)


def macenko(rgb: Stack, least: float = 0.15, tail: float = 1.0) -> Stack:
    """Macenko et al. 2009: tiles as if stained like the target; those with fewer than 3 dense pixels stay as they are."""
    px = rgb.reshape(len(rgb), -1, 3)
    density = _DENSITY[px]
    dense = (density > least).all(axis=2)
    n = dense.sum(axis=1)
    changed = np.flatnonzero(n >= 3)
    if not len(changed):
        return rgb
    density, dense, n = density[changed], dense[changed], n[changed]
    weight = dense[..., None]
    mean = (density * weight).sum(axis=1, keepdims=True) / n[:, None, None]
    apart = (density - mean) * weight
    _, axes = np.linalg.eigh(np.swapaxes(apart, 1, 2) @ apart / (n - 1)[:, None, None])
    plane = axes[:, :, 1:]
    flat = density @ plane
    angle = np.sort(np.where(dense, np.arctan2(flat[..., 1], flat[..., 0]), np.inf), axis=1)
    ends = np.stack([_percentile(angle, n, q) for q in (tail, 100 - tail)], axis=1)
    stained = plane @ np.stack([np.cos(ends), np.sin(ends)], axis=1)
    swap = stained[:, 0, 0] > stained[:, 0, 1]
    stained[swap] = stained[swap][:, :, ::-1]
    amounts = density @ np.swapaxes(np.linalg.pinv(stained), 1, 2)
    full = np.maximum(np.percentile(amounts, 99, axis=1), 1e-8)
    rebuilt = np.clip((amounts * (TARGET_DENSITY / full)[:, None, :]) @ TARGET_STAINS.T, 0, 20)
    out = px.copy()
    out[changed] = np.clip(255 * np.exp(-rebuilt), 0, 255).astype(np.uint8)
    return out.reshape(rgb.shape)


def macenko_normalize(tiles: DataFrame) -> DataFrame:
    return with_bytes(tiles, lambda rgb, rows: macenko(rgb))


def normalization_failed(tiles: DataFrame) -> DataFrame:
    """Tiles whose values are too dark, too light or too even to be used."""

    def kernel(rgb: Stack, rows: pa.Table) -> dict:
        v = rgb.reshape(len(rgb), -1).astype(np.int64)
        n, s, q = v.shape[1], v.sum(axis=1), np.square(v).sum(axis=1)
        return {"mean": s / n, "sd": np.sqrt((n * q - s * s) / n**2)}

    stats = mapped(tiles, kernel, "mean double, sd double")
    return stats.withColumn("failed", (F.col("mean") < 5) | (F.col("mean") > 250) | (F.col("sd") < 2))
