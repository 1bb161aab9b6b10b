"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals' subspaces are fitted on a bounded sample (`sample_rows`
vectors, chosen by a hash of the vector). Every vector is indexed: assigned to its nearest centroid's list, its
residual coded subspace by subspace. A query looks at its best lists, `probe_share` of them. There asymmetric distance
tables - the query's inner products with all code words - score the codes, and the best `rerank` of all lists, with
all that tie with the last of them, are ranked by their exact inner product in double precision.

Equal vectors are one class, which is indexed, and asked, once. As ties go to the smaller vec_id, a class needs only its
k + 1 smallest vec_ids, however many rows it has.

Lists are gathered in blocks of about `block_rows` vectors; a list that is larger than a block is split over several by
a hash. A query is sent to the blocks that hold lists it looks at, in chunks of about `chunk_rows` queries, and each block
returns its best `rerank`, so nothing of the best is left out and no task holds more than a block and a chunk. The number
of lists grows with the square root of the number of vectors, up to the size of the sample.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Repeated vec_ids: every row with a query's vec_id asks, and all rows but itself are candidates. With fewer candidates
than k all are returned. An empty table gives an empty result; other columns don't matter, whatever their names. On
vectors without clusters (as random ones) recall needs most lists; `probe_share` says how many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .heat import attached, hot_keys
from .store import written

SAMPLE_ROWS, BLOCK_ROWS, CHUNK_ROWS, K = 8192, 65_536, 65_536, 20
#: Small tables are still cut into so many blocks, so that their work is shared out.
LEAST_BLOCKS = 12
PROBE_SHARE, RERANK, SUBSPACES, CODES = 0.75, 150, 32, 256


#: A score may be off by so many standard deviations of its error.
ERRORS = 3.0


def seeded(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, drawn in steps by their squared distance from those drawn before, so groups of near copies get few."""
    chosen = rng.integers(len(x), size=1)
    far = np.full(len(x), np.inf)
    fresh = chosen
    while len(chosen) < k:
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            apart = (part * part).sum(axis=1)[:, None] + (x[fresh] * x[fresh]).sum(axis=1) - 2 * part @ x[fresh].T
            far[i : i + 4096] = np.minimum(far[i : i + 4096], np.maximum(apart, 0).min(axis=1))
        far[chosen] = 0
        left = np.flatnonzero(far > 0)
        many = min(max(1, k // 128), k - len(chosen), len(left))
        if not many:  # all rows are drawn, or copies of such
            rest = np.setdiff1d(np.arange(len(x)), chosen)
            return x[np.r_[chosen, rng.permutation(rest)[: k - len(chosen)]]].copy()
        fresh = rng.choice(left, many, replace=False, p=far[left] / far[left].sum())
        chosen = np.r_[chosen, fresh]
    return x[chosen].copy()


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from a seeded choice; an empty cluster keeps its centroid."""
    c = seeded(x.astype(np.float64), min(k, len(x)), np.random.default_rng(seed)).astype(x.dtype)
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in blocks of rows."""
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Quantizer:
    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, lists)
        self.cuts = np.linspace(0, self.dim, min(subspaces, self.dim) + 1).astype(int)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [kmeans(rest[:, a:z], codes, rounds=5) for a, z in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and codes of each vector, and the length of what they leave out."""
        own = nearest(x, self.coarse)
        rest = x - self.coarse[own]
        codes = [nearest(rest[:, a:z], b) for a, z, b in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        for (a, z, b), code in zip(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True), codes, strict=True):
            rest[:, a:z] -= b[code]
        return own, np.stack(codes, axis=1).astype(np.uint8), np.sqrt((rest * rest).sum(axis=1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with all code words: query x subspace x code."""
        out = np.full((len(q), len(self.books), max(map(len, self.books))), 0.0, dtype=np.float32)
        for j, (a, z, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[:, j, : len(b)] = q[:, a:z] @ b.T
        return out


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.coalesce(finite & some, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def hashed(rows: DataFrame) -> DataFrame:
    """rows with two independent 64-bit hashes of the vector, which name its class; zeros count without their sign."""
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(rows.schema["v"].dataType.elementType)).otherwise(x))
    return rows.withColumn("p", plain).withColumns({"h1": F.xxhash64("p"), "h2": F.xxhash64(F.lit(1), F.reverse("p"))}).drop("p")


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(c, h1, h2, v, asked, n_asked, ids): the distinct vectors of (vec_id, v, h1, h2, asked), with the k + 1 smallest vec_ids."""
    least = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.select("h1", "h2", "vec_id").withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    ids = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count_if("asked").alias("n_asked"))
    return written(one.join(ids, ["h1", "h2"]).withColumn("c", F.monotonically_increasing_id()), "classes")


def fit(classes: DataFrame, total: int, sample_rows: int = SAMPLE_ROWS) -> Quantizer | None:
    """A quantizer from about sample_rows distinct vectors."""
    u = F.pmod(F.col("h1"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = classes.where(u < min(1.0, sample_rows / max(total, 1))).select("v").toPandas() if total else None
    if sample is None or sample.empty:
        sample = classes.limit(1).select("v").toPandas()
        if sample.empty:
            return None
    x = np.stack(sample["v"].to_numpy()).astype(np.float32)
    order = np.lexsort(x.T)
    return Quantizer(x[order], lists=max(1, math.isqrt(total)))


def blocks_of(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each list's first block and number of blocks, and the number of all blocks: whole lists, in order, up to about
    block_rows vectors a block; larger lists are split."""
    first, parts, block, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[i], parts[i] = block, max(1, math.ceil(n / block_rows))
        held += n
        if parts[i] > 1:
            block, held = block + int(parts[i]), 0
    return first, parts, block + (held > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _index_batches(quantizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantizer = quantizer.value
        for batch in batches:
            if batch.num_rows:
                own, codes, left = q.encode(_matrix(batch.column("v"), q.dim).astype(np.float32))
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(own.astype(np.int32)), packed, pa.array(left.astype(np.float32))], names=["c", "list", "code", "left"])

    return run


def _probe_batches(quantizer, layout, probes: int):
    """For each query and block that holds lists it looks at a row with these lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantizer = quantizer.value
        first, parts, _ = layout.value
        for batch in batches:
            v = _matrix(batch.column("v"), q.dim).astype(np.float32)
            ids = batch.column("c").to_numpy()
            for at in range(0, len(v), 64):
                score = v[at : at + 64] @ q.coarse.T
                best = np.sort(np.argsort(-score, axis=1, kind="stable")[:, :probes], axis=1)
                rows = []
                for i, lists in enumerate(best):
                    block = np.repeat(first[lists], parts[lists]) + np.arange(parts[lists].sum()) - np.repeat(np.cumsum(parts[lists]) - parts[lists], parts[lists])
                    member = np.repeat(lists, parts[lists])
                    order = np.argsort(block, kind="stable")
                    cuts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
                    rows += [(int(block[order[a]]), int(ids[at + i]), v[at + i], member[order[a:z]].astype(np.int32)) for a, z in zip(cuts, np.r_[cuts[1:], len(order)], strict=True)]
                columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "q", "v", "lists"])

    return run


def _search_block(quantizer, k: int, rerank: int):
    """The best of a block for each query of a chunk, by asymmetric distance tables, with all that tie with the last or may be among the
    k + 1 nearest (one of them is the query), and by how much each score may be off."""

    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        q: Quantizer = quantizer.value
        found: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(members):
            members = members.sort_values(["list", "c"], kind="stable")
            ids, lists, left = (members[c].to_numpy() for c in ("c", "list", "left"))
            codes = np.ascontiguousarray(np.frombuffer(b"".join(members["code"]), dtype=np.uint8).reshape(len(ids), -1).T).astype(np.int64)
            starts, ends = np.searchsorted(lists, np.arange(len(q.coarse))), np.searchsorted(lists, np.arange(len(q.coarse)), side="right")
            for at in range(0, len(queries), 64):
                part = queries.iloc[at : at + 64]
                v = np.stack(part["v"].to_numpy()).astype(np.float32)
                tables, base = q.tables(v), v @ q.coarse.T
                spread = ERRORS * np.sqrt((v * v).sum(axis=1) / q.dim)
                for i, (query, probed) in enumerate(zip(part["q"].to_numpy(), part["lists"], strict=True)):
                    probed = probed[ends[probed] > starts[probed]]
                    sizes = ends[probed] - starts[probed]
                    rows = np.repeat(starts[probed] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    score = np.repeat(base[i, probed], sizes)
                    own = codes[:, rows]
                    for j, table in enumerate(tables[i]):
                        score += table[own[j]]
                    off = spread[i] * left[rows]
                    if len(rows) > rerank:
                        last = np.partition(score, len(score) - rerank)[len(score) - rerank]
                        surely = np.partition(score - off, len(score) - k - 1)[len(score) - k - 1]
                        best = np.flatnonzero((score >= last) | (score + off >= surely))
                        rows, score, off = rows[best], score[best], off[best]
                    found.append((np.full(len(rows), query), ids[rows], score, off))
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.float32)]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else empty
        return pd.DataFrame(dict(zip(("q", "c", "near", "off"), columns, strict=True)))

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, probe_share: float = PROBE_SHARE, rerank: int = RERANK, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row for which is_query (of vec_id) holds."""
    spark = vectors.sparkSession
    rows = hashed(usable(vectors)).withColumn("asked", is_query)
    classes = classes_of(rows, k)
    total, asked, rows_asked = classes.agg(F.count("*"), F.count_if(F.col("n_asked") > 0), F.sum("n_asked")).first()
    model = fit(classes, total)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(model)
    index = written(classes.select("c", "v").mapInArrow(_index_batches(shared), "c long, list int, code binary, left float"), "ivf")
    sizes = np.zeros(len(model.coarse), dtype=np.int64)
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    first, parts, blocks = blocks_of(sizes, min(block_rows, max(1024, total // LEAST_BLOCKS)))
    layout = spark.sparkContext.broadcast((first, parts, blocks))
    where = spark.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, parts, strict=True))], "list int, first int, parts int")
    chunks = max(1, math.ceil(asked / chunk_rows))
    block = (F.col("first") + F.pmod(F.xxhash64("c"), F.col("parts"))).cast("int")
    members = index.join(F.broadcast(where), "list").select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "c", "list", "code", "left")
    probes = max(1, math.ceil(probe_share * len(model.coarse)))
    queries = classes.where("n_asked > 0")
    sent = queries.select("c", "v").mapInArrow(_probe_batches(shared, layout, probes), "block int, q long, v array<float>, lists array<int>")
    sent = sent.select("block", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int").alias("chunk"), "q", "v", "lists")
    found = sent.groupBy("block", "chunk").cogroup(members.groupBy("block", "chunk")).applyInPandas(_search_block(shared, k, max(rerank, k + 1)), "q long, c long, near float, off float")
    top = _reranked(found, classes, k, rerank)
    # every asking row gets its class's list without itself
    asking = rows.where("asked").select("vec_id", "h1", "h2")
    answers = queries.select("h1", "h2", F.col("c").alias("own"), "n_asked").join(top, F.col("own") == top["q"], "left").drop("q")
    each = attached(asking, answers, ["h1", "h2"], hot_keys(queries, ["h1", "h2"], rows_asked or 0, "n_asked"))
    itself = F.array_position(F.transform("best", lambda b: (b["c"] == F.col("own")) & (b["vec_id"] == F.col("vec_id"))), True)
    others = F.filter("best", lambda b, i: i + 1 != itself)
    ranked = each.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("i", "b"))
    return ranked.select("query_id", (F.col("i") + 1).alias("rank"), "b.vec_id", "b.score")


def _reranked(found: DataFrame, classes: DataFrame, k: int, rerank: int) -> DataFrame:
    """(q, best): for each class that asks the k + 1 best rows, itself included, by exact score, then vec_id."""
    by = Window.partitionBy("q")
    low = F.col("near") - F.col("off")
    placed = found.withColumns({"r": F.rank().over(by.orderBy(F.desc("near"))), "s": F.row_number().over(by.orderBy(low.desc()))})
    surely = F.max(F.when(F.col("s") == k + 1, low)).over(by)
    within = placed.withColumn("surely", surely).where((F.col("r") <= rerank) | (F.col("near") + F.col("off") >= F.coalesce("surely", F.lit(float("-inf")))))
    short = within.select("q", "c")
    exact = short.join(classes.select("c", F.col("v").alias("y")), "c").join(classes.select(F.col("c").alias("q"), F.col("v").alias("x")), "q")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = exact.select("q", "c", dot.alias("score")).withColumn("r", F.rank().over(by.orderBy(F.desc("score")))).where(F.col("r") <= k + 1)
    rows = scored.join(classes.select("c", "ids"), "c").select("q", "c", "score", F.explode("ids").alias("vec_id"))
    last = rows.withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "vec_id", "c"))).where(F.col("r") <= k + 1)
    return last.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "vec_id", "score"))), lambda x: x.dropFields("r")).alias("best"))
