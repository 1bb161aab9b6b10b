"""Packed tiles against plain versions, a tile at a time."""

import os
import struct
import time
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from veridex.operators import tiles
from veridex.plans import fixtures
from veridex.sources import files

SF = "/root/testdata/sf0.001"


def packed(spark, *images):
    rows = [(i, *im.shape[:2], bytearray(im.astype(np.uint8).tobytes())) for i, im in enumerate(images)]
    return spark.createDataFrame(rows + [(99, None, None, None)], tiles.TILE)


def shown(df):
    return {r["image_id"]: np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3) for r in df.collect()}


def random_images(seed, n, height=12, width=12):
    return list(np.random.default_rng(seed).integers(20, 256, (n, height, width, 3)))


def test_tissue_rule_tie_and_rounding(spark):
    image = np.array([[[204, 204, 204], [203, 203, 203], [250, 225, 240], [255, 255, 255]]])
    assert tiles.is_tissue(image[None].astype(np.uint8)).tolist() == [[[False, True, True, False]]]
    region = spark.createDataFrame([(0, 15)], "image_id long, mask long")
    assert shown(tiles.masked(packed(spark, image), region, "mean", 1))[0][0, 0, 0] == round((204 + 203 + 250 + 255) / 4)


def test_shapes_mix_and_unreadable_tiles_have_no_results(spark):
    images = [im for k in range(3) for im in random_images(k, 4, 4 + k, 8 - k)]
    df = packed(spark, *images).repartition(2)
    got = {r["image_id"]: (r["px"], r["tissue_px"], r["gray_px"]) for r in tiles.tissue_counts(df).collect()}
    luma = lambda im: (im * [299, 587, 114]).sum(axis=2) + 500
    assert got == {i: (im[..., 0].size, int((((s := im.max(2) - im.min(2)) * 100 > 8 * im.max(2)) | (im.max(2) < 204)).sum()), int((luma(im) // 1000 < 220).sum())) for i, im in enumerate(images)}
    assert tiles.tissue_counts(df.limit(0)).collect() == []


def test_masks_change_their_regions_alone(spark):
    images = random_images(1, 3)
    regions = spark.createDataFrame([(0, 0b1), (1, 0), (2, 0xFFFF)], "image_id long, mask long")
    for name in tiles.MASKERS:
        got = shown(tiles.masked(packed(spark, *images), regions, name, 3))
        assert (got[1] == images[1]).all() and (got[0][3:] == images[0][3:]).all() and (got[0][:3, :3] != images[0][:3, :3]).any()
        assert got[2].std() < images[2].std()


def test_bits_survive_packing(spark):
    images = random_images(2, 5, 5, 7)
    rows = tiles.with_masks(packed(spark, *images), m=lambda rgb: rgb[..., 0] > 200).collect()
    for r in rows:
        bits = np.unpackbits(np.frombuffer(r["m"], np.uint8), count=35).reshape(5, 7)
        assert (bits == (images[r["image_id"]][..., 0] > 200)).all()


def test_boxes_and_cells_by_four_reads(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BOXES", 7)
    images = random_images(3, 3, 11, 9)
    tables = tiles.integrals(packed(spark, *images), px=tiles.MEASURES["px"], dark=lambda rgb: rgb[..., 1] < 90)
    rng = np.random.default_rng(4)
    boxes = [(int(i), *map(int, b)) for i in (0, 1, 2, 7) for b in rng.integers(-3, 14, (40, 4))]
    found = tiles.box_sums(tables, spark.createDataFrame(boxes, "image_id long, y0 int, x0 int, y1 int, x1 int")).collect()
    want = []
    for i, y0, x0, y1, x1 in boxes:
        if i < 3:
            part = images[i][max(y0, 0) : max(y1, 0), max(x0, 0) : max(x1, 0)]
            want.append((i, y0, x0, y1, x1, part[..., 0].size, int((part[..., 1] < 90).sum())))
    assert sorted(map(tuple, found)) == sorted(want)
    for r in tiles.cell_sums(tables, 3).collect():
        im = images[r["image_id"]]
        assert r["dark"] == [int((im[y * 3 : y * 3 + 3, x * 3 : x * 3 + 3, 1] < 90).sum()) for y in range(4) for x in range(4)]
    with pytest.raises(Exception, match="cells"):
        tiles.cell_sums(tables, 2).collect()


def plain_parts(mask):
    """The size of each pixel's 4-connected part, by filling."""
    out, seen = np.zeros(mask.shape, int), np.zeros(mask.shape, bool)
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        todo, part = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            part.append((a, b))
            for c, d in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        for p in part:
            out[p] = len(part)
    return out


def spiral(n):
    """One path of pixels that winds to the middle: rings, each open at its upper left, where it goes on to the next."""
    mask = np.zeros((n, n), bool)
    for k in range(0, n // 2, 2):
        end = n - k
        mask[k, k:end] = mask[k:end, end - 1] = mask[end - 1, k:end] = mask[k + 2 : end, k] = mask[k + 2, k : k + 3] = True
    return mask


def test_a_spiral_of_224_pixels_takes_few_passes():
    mask = spiral(224)
    began = time.perf_counter()
    start, end, part = tiles.runs_and_parts(np.stack([mask, ~mask, mask.T]))
    assert time.perf_counter() - began < 2
    first = part[start < 224 * 224]
    assert len(set(first.tolist())) == 1 and (end - start)[start < 224 * 224].sum() == mask.sum() > 20_000


def plain_macenko(rgb):
    density = -np.log((rgb.astype(float) + 1) / 256)
    dense = density[(density > 0.15).all(axis=1)]
    if len(dense) < 3:
        return rgb
    _, axes = np.linalg.eigh(np.cov(dense.T))
    x, y = (dense @ axes[:, 1:]).T
    ends = [axes[:, 1:] @ (np.cos(a), np.sin(a)) for a in np.percentile(np.arctan2(y, x), (1, 99))]
    stains = np.array(sorted(ends, key=lambda v: v[0])).T
    amounts = np.linalg.lstsq(stains, density.T, rcond=None)[0]
    full = np.maximum(np.percentile(amounts, 99, axis=1), 1e-8)
    return np.clip(255 * np.exp(-np.clip(tiles.TARGET_STAINS @ (amounts * (tiles.TARGET_DENSITY / full)[:, None]), 0, 20)).T, 0, 255).astype(np.uint8)


def test_macenko_equals_a_tile_at_a_time():
    stack = np.stack([*random_images(6, 6), np.full((12, 12, 3), 250)]).astype(np.uint8)
    got = tiles.macenko(stack)
    assert (got[-1] == 250).all()
    for a, b in zip(got, stack):
        assert np.abs(a.astype(int) - plain_macenko(b.reshape(-1, 3)).reshape(b.shape).astype(int)).max() <= 1  # rounding of sums


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_registered_queries_without_sql_equal_a_tile_at_a_time(spark):
    ids = np.array([r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()])
    drawn = dict(zip(ids.tolist(), fixtures.drawn(ids)))
    for r in entry.queries()["i15_macenko"](spark, SF).collect():
        want = plain_macenko(drawn[r["image_id"]].reshape(-1, 3)).astype(int).sum(axis=0)
        assert max(abs(r[c] - want[k]) for k, c in enumerate("rgb")) <= 6
    for r in entry.queries()["i12_stain_partition"](spark, SF).collect():
        rgb = drawn[r["image_id"]]
        tissue = tiles.is_tissue(rgb[None])[0]
        z = []
        for v in tiles.stains(rgb):
            s = tiles._kernel(8, 0.5) @ v @ tiles._kernel(8, 0.5).T
            z.append((s - s[tissue].mean()) / s[tissue].std())
        parts = []
        for m in (tissue & (z[0] > z[1]), tissue & ~(z[0] > z[1])):
            wide = np.pad(m, 1)
            inner = np.array([[wide[y : y + 3, x : x + 3].all() for x in range(8)] for y in range(8)])
            wide = np.pad(inner, 1)
            grown = np.array([[wide[y : y + 3, x : x + 3].any() for x in range(8)] for y in range(8)])
            parts.append(int((plain_parts(grown) >= 2).sum()))
        assert (r["epithelium_px"], r["stroma_px"]) == tuple(parts)


def png(path, image):
    h, w, _ = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + image[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_become_tiles_and_bad_ones_rows(spark, tmp_path):
    image = np.arange(2 * 3 * 3).reshape(2, 3, 3) * 5
    (tmp_path / "plain").mkdir()
    png(tmp_path / "plain" / "a.png", image)
    (tmp_path / "plain" / "b.png").write_bytes(b"not a picture")
    rows = {r["origin"].rsplit("/", 1)[1]: r for r in files.read_tiles(spark, str(tmp_path / "plain")).collect()}
    assert rows["b.png"]["error"] and rows["b.png"]["rgb"] is None and rows["b.png"]["height"] is None
    assert np.frombuffer(rows["a.png"]["rgb"], np.uint8).tolist() == image.reshape(-1).tolist() and rows["a.png"]["error"] is None
    images = [im for k in range(3) for im in random_images(7 + k, 2, 5 + k, 7 - k)]
    files.write_images(files.encode_tiles(packed(spark, *images)), str(tmp_path / "written"))
    back = shown(files.read_tiles(spark, str(tmp_path / "written")))
    assert len(back) == 6 and all((back[i] == im).all() for i, im in enumerate(images))


def test_few_bytes_in_many_images_are_written_by_all_tasks(spark, tmp_path):
    """The images come as one small partition, and Spark would coalesce it again; each is opened by a task of its own share."""
    one = files.encode_tiles(packed(spark, *random_images(3, 40)).coalesce(1))
    files.write_images(one, str(tmp_path / "many"))
    parts = {p.name.split("-")[1] for p in (tmp_path / "many").glob("image_id=*/*.txt")}
    assert len(parts) >= 8 and files.read_tiles(spark, str(tmp_path / "many")).where("error IS NULL").count() == 40


def test_dilation_and_structures(spark):
    image = np.full((8, 8, 3), 100)
    image[0, 0] = image[5, 5] = (240, 100, 100)
    image[4, 4] = 255  # no tissue
    df = tiles.with_masks(packed(spark, image), m=lambda rgb: rgb[..., 0] == 240, c=lambda rgb: rgb[..., 0] > 200)
    assert [r["n"] for r in tiles.dilate(df, "m").collect()] == [4 + 8]
    r = tiles.structure_accounting(df, "m", "c").first()
    assert (r["mask_px"], r["control_px"], r["pct_of_tile"]) == (2, 3, 100 * 2 / 64) and abs(r["overlap_pct_of_control"] - 200 / 3) < 1e-9
    rows = {(r["block"]): (r["masked"], r["tissue_share"]) for r in tiles.blocks(df, "m", 2).collect()}
    assert rows[0] == (1, 1.0) and rows[10] == (1, 0.75) and rows[1] == (0, 1.0) and len(rows) == 16


def test_equal_values_have_no_deviation(spark):
    z = tiles.stain_zscores(packed(spark, np.full((4, 4, 3), 77), np.full((4, 4, 3), 255))).collect()
    assert len(z) == 1 and z[0]["z_eosin"] == [0.0] * 16 and z[0]["n_tissue"] == 16


def test_partition_keeps_apart(spark):
    for r in tiles.stain_partition(packed(spark, *random_images(8, 4)), 1.0, 3).collect():
        e, s = (np.unpackbits(np.frombuffer(r[c], np.uint8), count=144).astype(bool) for c in ("epithelium", "stroma"))
        assert not (e & s).any() and e.sum() == r["epithelium_px"] and s.sum() == r["stroma_px"]
