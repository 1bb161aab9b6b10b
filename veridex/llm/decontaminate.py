"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of `window` consecutive words (a shorter item is one window). A window is the
set of its word shingles; a document holds the window only if it holds all of them, so by the prefix filter one
shingle is enough to look for: the window's rarest over the whole corpus. Documents meet windows in that
shingle. Its place in the window says where the window would begin (positional bound) and whether it ends
within the document (length bound); what is left is compared word by word.

The index of windows is measured first and cut into blocks of at most `block_bytes`; each block is broadcast
and passes over all documents, so no benchmark is too large and documents are never shuffled. A document's
hits gather from block to block.

Nulls: null texts have no words; rows with null item_id are items named "" in lists of items. Repeated items
count by item_id, repeated documents each get their row. Without items nothing is contaminated; without documents the
result is empty. Texts of any length are read whole, a slice of whole texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

WINDOW, SHINGLE = 10, 3
BLOCK_BYTES = 32 << 20
_HITS = "array<struct<start:int,end:int>>"


def _lowered(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = T.utf8(part.column("text"))
    return T.lower_ascii(data), offsets


def _words(part: pa.RecordBatch):
    data, offsets = _lowered(part)
    starts, ends, first = T.words(data, offsets, T.ALPHANUMERIC)
    return data, starts, ends, first


def _window_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            data, starts, ends, first = _words(part)
            items, rows = part.column("item_id").to_pylist(), []
            for i, item in enumerate(items):
                a, z = first[i], first[i + 1]
                w = [data[s:e].tobytes() for s, e in zip(starts[a:z], ends[a:z], strict=True)]
                for at in range(max(1, len(w) - window + 1) if w else 0):
                    rows.append((str(item) if item is not None else "", b" ".join(w[at : at + window]), min(window, len(w))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32())], names=["item", "words", "n"]
            )

    return T.releasing(run)


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, n, items): the distinct windows of all items, with the items that hold each."""
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    each = texts.mapInArrow(_window_batches(window), "item string, words binary, n int")
    return each.groupBy("words", "n").agg(F.collect_set("item").alias("items"))


def _gram_sizes(sizes: set[int], shingle: int) -> list[int]:
    return sorted({min(shingle, n) for n in sizes})


class Index:
    """A block of windows: words, their hashes, and the shingle that each is looked for by."""

    def __init__(self, rows: list[tuple[bytes, int, list[str]]], shingle: int = SHINGLE):
        self.rows, self.shingle = rows, shingle
        split = [r[0].split(b" ") for r in rows]
        flat = np.frombuffer(b"".join(w for ws in split for w in ws) or b"", dtype=np.uint8)
        sizes = np.array([len(w) for ws in split for w in ws], dtype=np.int64)
        ends = np.cumsum(sizes)
        h = T.word_hashes(flat, ends - sizes, ends)
        at = np.r_[0, np.cumsum([len(ws) for ws in split])].astype(np.int64)
        self.n = np.array([r[1] for r in rows], dtype=np.int64)
        self.full = np.array([T.grams(h[a:z], z - a)[0] for a, z in zip(at[:-1], at[1:], strict=True)], dtype=T.U)
        #: for each window, the hashes of its shingles in order
        self.shingles = [T.grams(h[a:z], min(shingle, z - a)) for a, z in zip(at[:-1], at[1:], strict=True)]
        self.wanted = np.unique(np.concatenate(self.shingles)) if rows else np.zeros(0, T.U)
        self.grams = _gram_sizes(set(self.n.tolist()), shingle)

    def rank(self, frequency: dict[int, int]) -> None:
        """Choose each window's rarest shingle: the one-element prefix of its ordered set."""
        seen = np.array([frequency.get(int(x), 0) for x in self.wanted.view(np.int64)], dtype=np.int64)
        key, self.offset = [], []
        for s in self.shingles:
            f = seen[np.searchsorted(self.wanted, s)]
            i = int(np.lexsort((s, f))[0])
            self.offset.append(i)
            key.append(s[i])
        order = np.argsort(np.array(key, dtype=T.U), kind="stable")
        self.key = np.array(key, dtype=T.U)[order]
        self.offset = np.array(self.offset, dtype=np.int64)[order]
        self.full, self.n = self.full[order], self.n[order]
        self.rows = [self.rows[i] for i in order]
        self.shingles = []


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of values that are in the sorted table; a bitmap of 16 bits goes before the search."""
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(table & T.U(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(values & T.U(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(table, values[maybe])
    at[at == len(table)] = 0
    return maybe[table[at] == values[maybe]] if len(table) else maybe[:0]


def _frequency_batches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        counts = np.zeros(len(block.wanted), dtype=np.int64)
        for part in T.slices(batches, "text"):
            data, starts, ends, first = _words(part)
            h = T.word_hashes(data, starts, ends)
            for n in block.grams:
                g = T.grams(h, n)
                at = _find(block.wanted, g)
                at = at[T.fits(first, n)[at]]
                counts += np.bincount(np.searchsorted(block.wanted, g[at]), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(T.signed(block.wanted[some])), pa.array(counts[some])], names=["shingle", "n"])

    return T.releasing(run)


def _hit_batches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for part in T.slices(batches, "text"):
            data, starts, ends, first = _words(part)
            h = T.word_hashes(data, starts, ends)
            hits = part.column("hits").to_pylist()
            items = part.column("items").to_pylist()
            fulls = {}
            for n in block.grams:
                g = T.grams(h, n)
                place = _find(block.key, g)
                low = np.searchsorted(block.key, g[place], side="left")
                many = np.searchsorted(block.key, g[place], side="right") - low
                place = np.repeat(place, many)
                entry = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else low
                mine = np.minimum(block.n[entry], block.shingle) == n
                place, entry = place[mine], entry[mine]
                begin = place - block.offset[entry]
                row = np.searchsorted(first, place, side="right") - 1
                inside = (begin >= first[row]) & (begin + block.n[entry] <= first[row + 1])
                begin, entry, row = begin[inside], entry[inside], row[inside]
                for size in np.unique(block.n[entry]):
                    if size not in fulls:
                        fulls[size] = T.grams(h, int(size))
                    at = np.flatnonzero((block.n[entry] == size))
                    at = at[fulls[size][begin[at]] == block.full[entry[at]]]
                    for b, e, r in zip(begin[at].tolist(), entry[at].tolist(), row[at].tolist(), strict=True):
                        words = b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(b, b + int(size)))
                        if words == block.rows[e][0]:
                            a = b - int(first[r])
                            if hits[r] and hits[r][-1]["end"] >= a >= hits[r][-1]["start"]:
                                hits[r][-1]["end"] = max(hits[r][-1]["end"], a + int(size))
                            else:
                                hits[r].append({"start": a, "end": a + int(size)})
                            items[r] = sorted({*items[r], *block.rows[e][2]})
            out = {name: part.column(name) for name in part.schema.names}
            out["hits"] = pa.array(hits, type=part.schema.field("hits").type)
            out["items"] = pa.array(items, type=part.schema.field("items").type)
            out["n_words"] = pa.array(np.diff(first))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return T.releasing(run)


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hits (stretches of words within occurring windows) and items (whose windows occur).

    Every row of docs stays, and every column, except that columns named hits, items and n_words give way to the new ones. docs
    needs a column text. (uncontaminated carries all columns, whatever their names.)
    """
    if not window >= shingle >= 1:
        raise ValueError("shingle must be between 1 and window")
    spark = docs.sparkSession
    windows = windows_of(items, window).withColumn("block_key", F.xxhash64("words"))
    size = windows.agg(F.sum(F.length("words") + F.size("items") * 16 + 200)).first()[0] or 0
    blocks = -(-size // block_bytes)
    texts = docs.select(*[F.col(c) for c in docs.columns if c not in ("hits", "items", "n_words", "text")], F.coalesce("text", F.lit("")).alias("text"))
    out = texts.withColumns({"hits": F.array().cast(_HITS), "items": F.array().cast("array<string>"), "n_words": F.lit(0).cast("long")})
    schema = out.schema
    for b in range(max(1, blocks)):
        mine = windows.where(F.pmod("block_key", F.lit(max(1, blocks))) == b).select("words", "n", "items").collect()
        index = Index([(bytes(r[0]), r[1], r[2]) for r in mine], shingle)
        shared = spark.sparkContext.broadcast(index)
        found = texts.select("text").mapInArrow(_frequency_batches(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n")).collect() if mine else []
        index.rank(dict(map(tuple, found)))
        out = out.mapInArrow(_hit_batches(spark.sparkContext.broadcast(index)), schema)
    return out


def covered(hits: str = "hits"):
    """How many words lie in at least one of the stretches."""
    ordered = F.array_sort(hits)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def step(acc, x):
        new = F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["to"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["to"], x["end"]).alias("to"))

    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def contamination_report(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = find_contamination(docs.select("doc_id", "text"), items, **settings)
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def uncontaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that hold no item's window, as they came."""
    whole = docs.select("text", F.struct(*docs.columns).alias("row"))
    return find_contamination(whole, items, **settings).where(F.size("hits") == 0).select("row.*")
