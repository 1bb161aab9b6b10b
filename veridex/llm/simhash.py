"""SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most 3 bits, one
segment differs in at most one bit, so the two share a variant of that segment: its value with one bit left
out. Every distinct fingerprint is indexed under its 2 x 32 variants, equality brings the members of a
variant together, and whole fingerprints are compared there.

A variant's members are linked by a spanning tree of verified links, never by all pairs; components are then
joined over these links. Members are distinct fingerprints: copies, however many, are one. The members of a hot
variant are dealt out before the shuffle, by each byte of the other segment (one of four must agree), so they
never meet in one task as a whole. Heat is estimated from a share of the fingerprints; it decides where members
meet, not which links are found.

Components are over fingerprints, so rows with one doc_id and different texts each keep their own. Nulls: a null
text has no shingle and fingerprint zero, like an empty one; a row with null doc_id gets its fingerprint and no
component. Repeated rows are returned as often as they occur. Texts of any length are read whole, in chunks of
shingles. An empty table gives an empty result; columns of docs with clashing names don't matter to
near_duplicates and stay in first_of_each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .text import releasing

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 3
#: A variant with about so many members is dealt out by the bytes of the other segment; its heat is estimated from one
#: fingerprint in HEAT_SHARE, and at most HOT_KEYS variants (16 bytes each) are sent to the executors. Larger groups that
#: remain are split in their task.
SPLIT_ABOVE, HEAT_SHARE, HOT_KEYS = 2048, 16, 50_000
_BLOCK = 512
_CHUNK_SHINGLES = 1 << 18


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, as a signed 64-bit number."""
    words = data.lower().split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([hash64(b" ".join(words), SEED)], dtype=np.uint64)
        return int(h.view(np.int64)[0])
    total = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK_SHINGLES):
        part = words[at : at + _CHUNK_SHINGLES + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        h = np.array([hash64(g, SEED) for g in grams], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(set_bits.view(np.int64)[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), dtype=np.int64, count=batch.num_rows)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "text"} | {"fp": pa.array(fps)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return releasing(run)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *others: Column) -> DataFrame:
    """(doc_id, others, fp): one row a document."""
    source = docs.select("doc_id", *others, F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(_fingerprint_batches(shingle), source.drop("text").schema.add("fp", "long"))


_LOW = 0xFFFFFFFF


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under the 64 one-wildcard variants of its two segments."""
    low, high = F.col("fp").bitwiseAND(_LOW), F.shiftrightunsigned("fp", 32)
    keys = [(high if v < 32 else low).bitwiseAND(_LOW & ~(1 << v % 32)).bitwiseOR(v << 32) for v in range(64)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def hot_variants(fps: DataFrame, split_above: int = SPLIT_ABOVE, share: int = HEAT_SHARE) -> DataFrame:
    """(key): the variants with about split_above members or more, the hottest HOT_KEYS of them."""
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0) if share > 1 else fps
    counted = variants(some).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * share >= split_above)
    return counted.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key")


def dealt(fps: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, part, fp): variants, those of hot ones under each byte of the other segment."""
    found = variants(fps).join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    other = F.when(F.shiftrightunsigned("key", 32) < 32, F.col("fp").bitwiseAND(_LOW)).otherwise(F.shiftrightunsigned("fp", 32))
    bytes_ = F.array(*[F.shiftrightunsigned(other, 8 * j).bitwiseAND(0xFF).bitwiseOR(j << 8).cast("int") for j in range(4)])
    return found.select("key", F.explode(F.when(F.col("hot"), bytes_).otherwise(F.array(F.lit(-1)))).alias("part"), "fp")


def _near(block: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(block[:, None] ^ rest) <= MAX_DISTANCE).any(axis=0)


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over distinct fingerprints that connects just what verified links connect."""
    left, tails, heads = np.unique(fps), [], []
    while len(left):
        root, rest = left[0], left[1:]
        frontier = left[:1]
        while len(frontier) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(frontier), _BLOCK):
                for to in range(0, len(rest), 8192):
                    near[to : to + 8192] |= _near(frontier[at : at + _BLOCK], rest[to : to + 8192])
            frontier, rest = rest[near], rest[~near]
            tails.append(frontier)
            heads.append(np.full(len(frontier), root))
        left = rest
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate(tails or [none]), np.concatenate(heads or [none])


def _compare(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the members of a variant."""
    hole = np.uint64(1) << np.uint64((key >> 32) % 32 + (32 if key >> 32 < 32 else 0))
    if (key >> 32) % 32 and len(np.unique(fps & hole)) < 2:
        return fps[:0], fps[:0]  # these agree in the whole segment: its first variant compares them
    if len(fps) <= SPLIT_ABOVE:
        return spanning_links(fps)
    shift = np.uint64(0 if key >> 32 < 32 else 32)
    other = (fps >> shift) & np.uint64(0xFFFFFFFF)
    tails, heads = [], []
    parts = [(other >> np.uint64(8 * byte)) & np.uint64(0xFF) for byte in range(4)]
    if any((p == p[0]).all() for p in parts):
        return spanning_links(fps)
    for part in parts:
        for value in np.unique(part):
            t, h = spanning_links(fps[part == value])
            tails.append(t)
            heads.append(h)
    return np.concatenate(tails), np.concatenate(heads)


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and part; a group's rows may run over several batches."""
    held_key, held = None, []

    def links(key, parts):
        t, h = _compare(key[0], np.concatenate(parts))
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(h.view(np.int64))], names=["u", "v"])

    for batch in batches:
        keys, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
        fps = batch.column("fp").to_numpy().view(np.uint64)
        if not len(keys):
            continue
        at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])])
        ends = np.r_[at[1:], len(keys)]
        for i, (a, z) in enumerate(zip(at.tolist(), ends.tolist(), strict=True)):
            if i and i < len(at) - 1:
                if z - a > 1:
                    yield links((int(keys[a]), int(part[a])), [fps[a:z]])
                continue
            key = (int(keys[a]), int(part[a]))
            if key != held_key:
                if sum(map(len, held)) > 1:
                    yield links(held_key, held)
                held_key, held = key, []
            held.append(fps[a:z].copy())
    if sum(map(len, held)) > 1:
        yield links(held_key, held)


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints within reach of one another. fps: distinct fp."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = dealt(fps, hot_variants(fps, SPLIT_ABOVE, HEAT_SHARE)).repartition(n, "key", "part").sortWithinPartitions("key", "part")
    return groups.mapInArrow(_link_groups, "u long, v long").dropDuplicates()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each linked node reaches, by alternating stars.

    Each round gathers neighbours as minima, which combine before the shuffle, and joins them back; a star's
    hub meets its links in that join, whose large partitions Spark splits.
    """

    def state(edges):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").dropDuplicates(), "links")
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).dropDuplicates()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").dropDuplicates(), "links")
        before, after = state(edges), before
        if before == after:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).dropDuplicates().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def linked(fps: DataFrame) -> DataFrame:
    """(fp, component): the component of each linked one of distinct fingerprints."""
    return components(written(near_links(fps), "links")).withColumnRenamed("node", "fp")


def _components_of(fps: DataFrame) -> DataFrame:
    """(fp, component, component_id): of each fingerprint in (doc_id, fp) its component and the least doc_id there."""
    classes = written(fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    named = classes.join(linked(classes.select("fp")), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): each document with the smallest doc_id that links reach from it."""
    fps = written(fingerprints(docs, shingle), "simhash")
    out = fps.join(_components_of(fps), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id stays, once; of several such
    rows the one with the smallest hash of its text. Rows with null doc_id stay.
    """
    edition = F.xxhash64(F.coalesce("text", F.lit("")))
    found = written(fingerprints(docs, shingle, edition.alias("edition")), "simhash")
    rows = found.where(F.col("doc_id").isNotNull()).join(_components_of(found.select("doc_id", "fp")), "fp")
    kept = rows.groupBy("component").agg(F.min(F.struct("doc_id", "edition")).alias("first")).select("first.*")
    whole = docs.where(F.col("doc_id").isNotNull()).select("doc_id", edition.alias("edition"), F.struct(*docs.columns).alias("row"))
    one = whole.join(kept.hint("merge"), ["doc_id", "edition"], "left_semi").groupBy("doc_id", "edition").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
