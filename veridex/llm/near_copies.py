"""Near copies by SimHash links and by exact Jaccard similarity of word shingles.

Two documents are near copies if the sets of their five-word shingles (a shorter text is one shingle) have a Jaccard
similarity of at least 0.8. Documents are kept in the order of doc_id: one stays unless it is a near copy of a smaller
one that stays. So every document that goes has a near copy that stays, and no chain of links drops unlike documents.

Candidates share a key. Some keys are SimHash links (see simhash: fingerprints at most 3 bits apart). At a similarity of 0.8 fingerprints of 64 bits differ in about ten bits, which deletion variants can't reach in bounded
space, so there are 40 keys more, of 8 MinHashes each: at similarity 0.8 a pair shares one with probability 0.999, at
0.9 or more with nearly 1. Every decision is taken on a candidate's exact similarity; the sets hold 32-bit hashes, of
which two sets of n agree by chance in n * n / 2 ** 32 on average. Documents with equal sets are one member.

First, for a few rounds, the least member of each key is compared with the others: that settles a large group of copies by one
comparison a member. Then every member that is left learns its least near copy among the members of its keys that aren't gone:
pairs of small keys are compared one by one; those of large keys, such as pages of one template that are all unlike, in blocks,
as products of matrices over the shingles that occur twice. A member without a smaller near copy stays, one whose least near copy stays
goes, and only the others look again. So rounds go with the length of chains of near copies, not with the size of keys.

Nulls: a null text is like an empty one; rows with null doc_id stay. Of rows with one doc_id and like texts (equal sets
of shingles) one stays, those with other texts are documents of their own and follow one another by a hash. Texts of any
length are read whole. An empty table gives an empty result; all columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .store import Scratch, written
from .text import releasing

SHINGLE, LEAST, BANDS, BAND_ROWS, SEED = 5, 0.8, 40, 8, 42
#: Rounds in which the least member of each key is compared, as long as they drop one row of keys in YIELD.
HEAD_ROUNDS, YIELD = 3, 20
#: Pairs of keys with at most SMALL members are compared one by one, those of others in blocks of about MEMBERS
#: or BLOCK_BYTES.
SMALL, MEMBERS, BLOCK_BYTES = 64, 1024, 4 << 20
#: Shingles that are multiplied at once; those in at most SPARSE pairs of a block are counted pair by pair.
COLUMNS, SPARSE = 4096, 64
_BLOCK = 1024
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash64(b" ".join(words), SEED)], dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.unique(np.fromiter((hash64(g, SEED) for g in grams), dtype=np.uint64, count=len(words) - shingle + 1))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The keys of a set of shingles; none of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, (hashes[at : at + _BLOCK, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingles; 1 of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def narrow(hashes: np.ndarray) -> np.ndarray:
    """The set by 32 bits of each hash, sorted."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [x.as_py() for x in part.column("text").cast(pa.large_binary())]
            sets = [shingles(x) for x in texts]
            columns = {
                "doc_id": part.column("doc_id"), "edition": part.column("edition"), "digest": pa.array([_digest(s) for s in sets], pa.binary()), "fp": pa.array([simhash.fingerprint(x) for x in texts], pa.int64()),
                "keys": pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), "shingles": pa.array([narrow(s).tobytes() for s in sets], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = lambda x: np.frombuffer(x.as_buffer(), dtype=np.uint32)
    for batch in batches:
        near = [jaccard(of(a), of(b)) >= LEAST for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
        yield batch.select(["node", "head"]).filter(pa.array(near, pa.bool_()))


def _near(pairs: DataFrame, sets: DataFrame, keep: Scratch) -> DataFrame:
    """The pairs (node, head) that are near copies."""
    a, b = sets.select("node", F.col("shingles").alias("a")), sets.select(F.col("node").alias("head"), F.col("shingles").alias("b"))
    heads = keep.written(b.join(pairs.select("head").distinct(), "head", "left_semi"), "heads")
    return pairs.join(a, "node").join(heads, "head").select("node", "head", "a", "b").mapInArrow(releasing(_near_batches), "node long, head long").dropDuplicates()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a has in common with each of b."""
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    every = np.concatenate([*a, *b]) if a or b else np.zeros(0, dtype=np.uint32)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column = np.unique(every, return_inverse=True)
    left = row < len(a)
    sides = [np.bincount(column[x], minlength=column.max(initial=-1) + 1) for x in (left, ~left)]
    pairs = sides[0].astype(np.int64) * sides[1]
    for chosen, dense in ((pairs > SPARSE, True), ((pairs > 0) & (pairs <= SPARSE), False)):
        number = np.cumsum(chosen) - 1
        at = chosen[column]
        (ra, ca), (rb, cb) = ((row[at & x] - shift, number[column[at & x]]) for x, shift in ((left, 0), (~left, len(a))))
        if dense:
            for low in range(0, int(chosen.sum()), COLUMNS):
                x, y = (np.zeros((len(side), COLUMNS), dtype=np.float32) for side in (a, b))
                for matrix, r, c in ((x, ra, ca), (y, rb, cb)):
                    inside = (c >= low) & (c < low + COLUMNS)
                    matrix[r[inside], c[inside] - low] = 1
                out += x @ y.T
        elif len(ra):
            order = np.argsort(ca, kind="stable")
            ra, first = ra[order], np.searchsorted(ca[order], np.arange(int(chosen.sum()) + 1))
            n = np.diff(first)[cb]
            partner = np.repeat(first[:-1][cb] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            np.add.at(out, (ra[partner], np.repeat(rb, n)), 1)
    return out


def _pack(table: pa.Table) -> pa.Table:
    """The members of one block of a key as one row."""
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    sets = table["shingles"].to_pylist()
    return pa.table({
        "key": table["key"].slice(0, 1).combine_chunks(), "block": table["block"].slice(0, 1).combine_chunks(), "nodes": one(table["node"].to_numpy(), pa.int64()),
        "open": one(table["open"].to_numpy(zero_copy_only=False), pa.bool_()), "sizes": one([len(x) // 4 for x in sets], pa.int32()), "data": pa.array([b"".join(sets)], pa.binary()),
    })


_PACKED = "key long, block int, nodes array<long>, open array<boolean>, sizes array<int>, data binary"
_NEVER = np.iinfo(np.int64).max


def _least_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, head): the least near copy that the open members of two blocks have in the other one."""

    def block(row: dict, side: str) -> tuple:
        sizes = np.array(row[f"sizes{side}"])
        data = np.frombuffer(row[f"data{side}"], dtype=np.uint32)
        return np.array(row[f"nodes{side}"]), np.array(row[f"open{side}"]), sizes, np.split(data, np.cumsum(sizes)[:-1])

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            (na, oa, sa, a), (nb, ob, sb, b) = block(row, "_a"), block(row, "_b")
            both = overlaps(a, b)
            near = both.astype(np.float64) * (1 + LEAST) >= LEAST * (sa[:, None] + sb[None, :]) - 1e-7
            found = []
            for x, y, is_open, hit in ((na, nb, oa, near), (nb, na, ob, near.T)):
                least = np.where(hit & (y[None, :] < x[:, None]), y[None, :], _NEVER).min(axis=1, initial=_NEVER)
                good = is_open & (least < _NEVER)
                found.append((x[good], least[good]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["node", "head"])


def _least_near(live: DataFrame, undecided: DataFrame, sets: DataFrame, keep: Scratch) -> DataFrame:
    """(node, head): of each undecided node its least near copy among smaller nodes with a common key, where there is one."""
    marked = live.join(undecided.withColumn("open", F.lit(True)), "node", "left").withColumn("open", F.coalesce("open", F.lit(False)))
    blocks = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("size") / BLOCK_BYTES)).cast("int")
    sized = marked.groupBy("key").agg(F.count("*").alias("n"), blocks.alias("blocks"), F.bool_or("open").alias("any")).where("any AND n > 1").select("key", "n", "blocks")
    rows = keep.written(marked.join(sized, "key"), "marked")
    small = rows.where(F.col("n") <= SMALL)
    pairs = small.where("open").select("key", "node").join(small.select("key", F.col("node").alias("head")), "key").where("head < node").select("node", "head").distinct()
    near = _near(keep.written(pairs, "pairs"), sets, keep)
    large = rows.where(F.col("n") > SMALL).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    packed = keep.written(large.join(sets, "node").select("key", "block", "node", "open", "shingles").groupBy("key", "block").applyInArrow(_pack, _PACKED), "blocks")
    side = lambda x: packed.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "nodes", "open", "sizes", "data")])
    met = side("a").join(side("b"), "key").where("block_a <= block_b AND (exists(open_a, x -> x) OR exists(open_b, x -> x))")
    # pairs of blocks are dealt out evenly; there are few of them, and each is long
    dealt = met.repartition(max(1, int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key", "block_a", "block_b")
    found = dealt.mapInArrow(releasing(_least_batches), "node long, head long")
    return keep.written(near.unionByName(found).groupBy("node").agg(F.min("head").alias("head")), "least")


_SIGNS = "doc_id long, edition long, digest binary, fp long, keys array<long>, shingles binary"


def kept(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, edition) that stay, and those that occur in several rows. texts: doc_id, edition, text, without nulls."""
    keep = Scratch(texts.sparkSession)
    signed = keep.written(texts.mapInArrow(releasing(_sign_batches), _SIGNS), "signs")
    # a class is a set of shingles; its first document stands for it, and it goes by a number that follows their order
    classes = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "edition")).alias("first")).select("first.*").orderBy("doc_id", "edition")
    # small tables are written before they meet the sets, so that their size is known and the sets stay where they are
    classes = keep.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    size = F.octet_length("shingles").alias("size")
    members = signed.select("doc_id", "edition", "fp", "keys", size).join(classes, ["doc_id", "edition"])
    links = keep.written(simhash.near_links(members.select("fp").distinct()), "links").withColumn("key", F.xxhash64("u", "v", F.lit("simhash")))
    linked = members.select("node", "fp", "size").join(links.select(F.explode(F.array("u", "v")).alias("fp"), "key"), "fp").select("node", "size", "key")
    keys = members.select("node", "size", F.explode("keys").alias("key")).unionByName(linked)
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    live = keep.written(keys.join(shared, "key").select("key", "node", "size").distinct(), "keys")
    # only members that share a key are compared: their sets are numbered once, and no others are moved
    alike = keep.written(classes.join(live.select("node").distinct(), "node", "left_semi"), "alike")
    sets = keep.written(signed.select("doc_id", "edition", "shingles").join(alike, ["doc_id", "edition"]).select("node", "shingles"), "sets")
    gone = classes.select("node").limit(0)
    before = live.count()
    for _ in range(HEAD_ROUNDS):
        heads = live.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
        if not heads.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] > SMALL:
            break
        found = keep.written(live.join(heads, "key").where("node <> head").select("node", "head").distinct(), "pairs")
        # a head that is no other one's node stays
        ready = keep.written(found.join(found.select(F.col("node").alias("head")).distinct(), "head", "left_anti").select("node", "head"), "ready")
        near = keep.written(_near(ready, sets, keep), "near").select("node")
        gone = gone.unionByName(near)
        done = near.unionByName(ready.select(F.col("head").alias("node"))).distinct()
        live = keep.written(live.join(done, "node", "left_anti").select("key", "node", "size"), "keys")
        before, left = live.count(), before
        if left - before < left / YIELD:
            break
    undecided = keep.written(live.select("node").distinct(), "undecided")
    while True:
        least = _least_near(live, undecided, sets, keep)
        # without a smaller near copy a node stays; one whose least near copy stays goes
        staying = undecided.join(least, "node", "left_anti").select("node")
        settled = live.select("node").distinct().join(undecided, "node", "left_anti").unionByName(staying)
        going = keep.written(least.join(settled.select(F.col("node").alias("head")), "head", "left_semi").select("node"), "going")
        rest = keep.written(least.select("node").join(going, "node", "left_anti"), "undecided")
        gone = gone.unionByName(going)
        if rest.isEmpty():
            break
        live, undecided = keep.written(live.join(going, "node", "left_anti").select("key", "node", "size"), "keys"), rest
    stay = written(classes.join(gone.distinct(), "node", "left_anti").select("doc_id", "edition"), "stay")
    repeated = written(signed.groupBy("doc_id", "edition").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "edition"), "repeated")
    keep.clear()
    return stay, repeated


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies of documents that stay, each of these once; rows with null doc_id stay."""
    edition = F.xxhash64(F.coalesce("text", F.lit("")))
    ours = docs.where(F.col("doc_id").isNotNull())
    stay, repeated = kept(ours.select("doc_id", edition.alias("edition"), F.coalesce("text", F.lit("")).alias("text")))
    whole = ours.select("doc_id", edition.alias("edition"), F.struct(*docs.columns).alias("row")).join(stay, ["doc_id", "edition"], "left_semi")
    once = whole.join(repeated, ["doc_id", "edition"], "left_anti").select("row")
    several = whole.join(repeated, ["doc_id", "edition"], "left_semi").groupBy("doc_id", "edition").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.unionByName(several).select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
