"""Substring dedup, SimHash and decontamination against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from veridex.llm import decontaminate, heat, near_copies, simhash, substring_dedup
from veridex.llm import text as T

DOC = "doc_id long, text string"
BLANKS = r"[^\x20\x09-\x0D]+"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "tion", "née", "ß", "a,", "B.", "x" * 90, *(f"w{i}" for i in range(60))]
    passage = " ".join(rng.choice(words) for _ in range(55))
    rows = []
    for i in range(n):
        w = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 80, 300])))
        rows.append((i * 3, w + ("\n" + passage + "\t" if i % 4 == 0 else "")))
    rows += [(1000, rows[5][1]), (1001, rows[7][1]), (1002, "p q r s " * 40), (1003, None), (1004, ""), (1005, "  \n ")]
    return rows


def test_words_and_grams():
    data = b"ab  c\nd" + b"ee f"
    array = np.frombuffer(data, dtype=np.uint8)
    starts, ends, first = T.words(array, np.array([0, 7, 7, 11]), T.BLANK_SEPARATED)
    assert [data[a:b] for a, b in zip(starts, ends)] == [b"ab", b"c", b"d", b"ee", b"f"]
    assert first.tolist() == [0, 3, 3, 5]
    h = T.word_hashes(array, starts, ends)
    for n in range(1, 6):
        assert len(T.grams(h, n)) == 6 - n
        again = T.grams(np.concatenate([h[:1], h]), n)
        assert (again[1:] == T.grams(h, n)).all()
    assert T.fits(first, 2).tolist() == [True, True, False, True]


def dedup_by_definition(docs):
    """Documents of one doc_id are ordered by the key that Spark gives them."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key")).collect()
    keys = {(r["doc_id"], r["text"] or ""): r["key"] for r in rows}
    return substring_dedup.brute_force([(r["doc_id"], r["text"]) for r in rows], lambda d, t: keys[d, t])


@pytest.mark.parametrize(("batches", "max_runs"), [(1, 1), (2, 1), (4, 1), (4, 9)])
def test_substring_dedup_is_exact(spark, batches, max_runs):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    found = substring_dedup.with_digest(substring_dedup.dedup_substrings(docs, batches=batches, max_runs=max_runs)).collect()
    assert sorted(map(tuple, found)) == dedup_by_definition(docs)
    assert any(r[2] for r in found)


def test_substring_dedup_of_repeated_ids(spark):
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    a, b = words("a", 30), words("b", 30)
    rows = [(0, a), (1, a), (1, b), (2, b), (2, b), (2, a + " " + b), (3, None), (3, words("c", 25)), (5, b)] * 2
    docs = spark.createDataFrame(rows, DOC).repartition(7)
    found = sorted(map(tuple, substring_dedup.with_digest(substring_dedup.dedup_substrings(docs)).collect()))
    assert found == dedup_by_definition(docs) and len(found) == len(rows)
    assert {r[2] for r in found if r[0] == 0} == {0} and {r[2] for r in found if r[0] == 5} == {30}
    assert sum(r[2] == 0 and r[1] == 30 for r in found if r[0] == 1) == 2  # the text that occurs nowhere before


def test_substring_dedup_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SLICE_BYTES", 4000)
    rng = random.Random(23)
    long = " ".join(f"w{rng.randint(0, 40)}" for _ in range(30_000))
    rows = [(1, long), (2, long[5000:90_000]), (3, "x " * 20_000), (4, "y" * 300_000), (5, long[-700:] + "\x0b" + long[:900])]
    docs = spark.createDataFrame(rows, DOC)
    found = sorted(map(tuple, substring_dedup.with_digest(substring_dedup.dedup_substrings(docs)).collect()))
    assert found == dedup_by_definition(docs)


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup_within_one_slice_and_across(spark, monkeypatch, most):
    monkeypatch.setattr(heat, "MOST", most)
    rows = [(i, " ".join(f"t{k}" for k in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, DOC).repartition(8)
    found = {r[0]: r[2] for r in substring_dedup.dedup_substrings(docs).collect()}
    assert found == {i: 0 if i == 0 else 30 for i in range(40)}


def test_substring_dedup_edges(spark):
    empty = spark.createDataFrame([], DOC)
    assert substring_dedup.dedup_substrings(empty).collect() == []
    odd = spark.createDataFrame([(None, "a " * 30, 1, 2), (None, "a " * 30, 2, 3)], "doc_id long, text string, candidates int, key int")
    assert [tuple(r[:3]) for r in substring_dedup.dedup_substrings(odd).collect()] == [(None, 30, 0)] * 2


def test_index_compacts_and_opens_again(spark):
    rows = corpus(3, 30)
    parts = [spark.createDataFrame(rows[i::3], DOC).withColumnRenamed("doc_id", "key") for i in range(3)]
    index = substring_dedup.FingerprintIndex(spark, max_runs=1)
    index.append(parts[0])
    index.append(parts[1])
    for name in index.runs:  # as in a session that has no such tables yet
        spark.sql(f"DROP TABLE {name}")
    again = substring_dedup.FingerprintIndex(spark, folder=index.folder, max_runs=1)
    assert again.runs == index.runs and len(again.runs) == 2
    late = {r[0] for r in again.append(parts[2]).collect()}
    assert len(again.runs) == 2  # the merged one and the new one
    merged = spark.table(again.runs[0])
    assert merged.count() == merged.select("slot").distinct().count() > 0
    repeated = {r[0] for r in dedup_by_definition(spark.createDataFrame(rows, DOC)) if r[2]}
    assert repeated & {d for d, _ in rows[2::3]} <= late
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, window=30, folder=index.folder)
    again.drop()


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(BLANKS, low)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(fps):
    ids = sorted(fps)
    least = {i: i for i in ids}
    for _ in ids:
        new = {i: min(least[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 3) for i in ids}
        if new == least:
            return least
        least = new
    return least


def test_simhash_matches_definition(spark):
    rows = corpus(2)
    rows += [(2000 + i, rows[10][1] + f" tail{i}") for i in range(30)]
    found = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    fps = {d: plain_fingerprint(t) for d, t in rows}
    assert {d: f % 2**64 for d, (f, _) in found.items()} == fps
    assert {d: c for d, (_, c) in found.items()} == plain_components(fps)


def test_variants_meet_up_to_three_bits():
    rng = random.Random(4)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        keys = lambda f: {(v, (f >> 32 if v < 32 else f & 0xFFFFFFFF) & ~(1 << v % 32)) for v in range(64)}
        assert keys(a) & keys(b)


def test_large_variant_groups_are_split_exactly(monkeypatch):
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 11, 700).astype(np.uint64))
    want = simhash.spanning_links(fps)
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", 10)
    got = simhash._compare(0, fps)

    def groups(links):
        root = {int(f): int(f) for f in fps}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for t, h in zip(*links):
            a, b = sorted((top(int(t)), top(int(h))))
            root[b] = a
        return {int(f): top(int(f)) for f in fps}

    assert groups(got) == groups(want)


@pytest.mark.parametrize("split", [2048, 4])
def test_hot_variants_are_dealt_out_exactly(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", split)
    monkeypatch.setattr(simhash, "HEAT_SHARE", 1)
    rng = random.Random(22)
    hot = rng.getrandbits(32)
    fps = {hot << 32 | rng.getrandbits(9) | (rng.getrandbits(4) << 20) for _ in range(250)} | {rng.getrandbits(64) for _ in range(40)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:60]}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5))
    found = {r["node"]: r["component"] for r in simhash.components(links).collect()}
    want = plain_components({f: f % 2**64 for f in signed})
    assert {f: found.get(f, f) for f in signed} == want
    if split == 4:
        assert simhash.hot_variants(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, 1).count() > 0


def test_simhash_of_repeated_ids(spark):
    p, q = " ".join(f"p{i}" for i in range(50)), " ".join(f"q{i}" for i in range(50))
    rows = [(5, p), (5, q), (6, p), (7, q), (5, p), (None, p)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{DOC}, fp int")
    found = simhash.near_duplicates(docs).collect()
    assert sorted(r["component_id"] or -1 for r in found) == [-1, 5, 5, 5, 5, 5]
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"][0]) for r in kept.collect()) == [(-1, "p"), (5, "p"), (5, "q")]


def test_simhash_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK_SHINGLES", 1000)
    rng = random.Random(24)
    rows = [(1, " ".join(f"W{rng.randint(0, 900)}" for _ in range(20_000))), (2, "Z" * 200_000), (3, "a b " * 30_000)]
    rows += [(4, rows[0][1] + " tail")]
    found = {r[0]: (r[1] % 2**64, r[2]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    fps = {d: plain_fingerprint(t) for d, t in rows}
    assert {d: f for d, (f, _) in found.items()} == fps and {d: c for d, (_, c) in found.items()} == plain_components(fps)


def test_simhash_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).collect() == []
    rows = [(None, "a b"), (4, None), (2, ""), (7, "a b"), (7, "a b")]
    found = sorted((tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert {r[2] for r in found if r[0] in (2, 4)} == {2} and [r[2] for r in found if r[0] is None] == [None]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, fp int")
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and sorted((r[0] or -1) for r in kept.collect()) == [-1, 2, 7]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r["component"] for r in simhash.components(links).collect()} == {0}


def plain_hits(text, items):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            window = v[i : i + 10]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500])
def test_decontamination_matches_definition(spark, block_bytes):
    rng = random.Random(6)
    words = ["Alpha", "beta", "é", "x1", "of", "the", "gamma-ray", "Ω"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 5, 9, 10, 11, 30, 30])] + [(100, None), (9, "of the"), (9, "of the")]
    items = [x for x in items if x[0] != 1]
    rows = [(i, f"{text(rng.choice([0, 3, 40]))}, {items[i % len(items)][1] or ''}! {text(9)}") for i in range(40)] + [(99, None), (99, "")]
    docs, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination_report(docs, bench, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, found)) == sorted((d, *plain_hits(t, items)) for d, t in rows)


def test_decontamination_of_very_long_texts(spark):
    rng = random.Random(29)
    words = ["alpha", "beta", "é", "x1", "of", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(15)
    rows = [(1, f"{text(6000)} {item} {text(3000)}"), (2, "q" * 300_000), (3, f"{'z' * 200_000} {item}")]
    found = decontaminate.contamination_report(spark.createDataFrame(rows, DOC), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted((d, *plain_hits(t, [(7, item)])) for d, t in rows)


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "h", 5)], "doc_id long, text string, hits string, row int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.uncontaminated(docs, none).collect()] == [(1, "a b c", "h", 5)]
    assert decontaminate.contamination_report(docs.limit(0), none).collect() == []
    with pytest.raises(ValueError):
        decontaminate.find_contamination(docs, none, window=2, shingle=3)


def plain_jaccard(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.mark.parametrize("small,members,rounds", [(64, 1024, 3), (2, 16, 0), (2, 7, 1)])
def test_stage_drops_near_copies_by_jaccard(spark, monkeypatch, small, members, rounds):
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    monkeypatch.setattr(near_copies, "HEAD_ROUNDS", rounds)
    rng = random.Random(21)
    rows, text = [], lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]

    def edited(words, *places):
        return " ".join("edit%d" % rng.randint(0, 9**9) if i in places else w for i, w in enumerate(words))

    for i in range(20):  # at 0.90, 0.81, and (apart) 0.73
        words = text(100)
        rows += [(4 * i, " ".join(words)), (4 * i + 1, edited(words, 50)), (4 * i + 2, edited(words, 30, 60)), (4 * i + 3, edited(words, 25, 50, 75))]
    hot = text(200)
    rows += [(1000 + i, edited(hot, rng.randrange(5, 195))) for i in range(150)]
    common = text(60)
    rows += [(2000 + i, " ".join([*common, *text(15)])) for i in range(9)]  # much alike, under 0.8
    kept, want = [], set()
    for i, t in sorted(rows):
        if all(plain_jaccard(t, k) < 0.8 for k in kept):
            kept.append(t)
            want.add(i)
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    found = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert near_copies.first_of_each(docs.limit(0)).collect() == []
    edges = spark.createDataFrame([(None, "a b"), (4, None), (2, ""), (7, "A b"), (7, "a b"), (9, "a b")], DOC)
    assert sorted(r[0] or -1 for r in near_copies.first_of_each(edges).collect()) == [-1, 2, 7]


def test_overlaps_of_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, top, n).astype(np.uint32)) for n in (0, 5, 40, 90)] for top in (50, 200))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    for sparse, columns in ((64, 4096), (0, 7), (2, 3)):
        monkeypatch.setattr(near_copies, "SPARSE", sparse)
        monkeypatch.setattr(near_copies, "COLUMNS", columns)
        assert near_copies.overlaps(a, b).tolist() == want
    assert near_copies.overlaps([], b).shape == (0, 4) and near_copies.overlaps(a, []).shape == (4, 0)


def test_templates_of_unlike_pages_end_in_few_rounds(spark):
    """1,500 pages of 290 words that share 240, and copies of some of them."""
    rng = random.Random(5)
    words = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    template = words(240)
    rows = [(i, " ".join([*template, *words(50)])) for i in range(1500)]
    rows += [(2000 + i, f"{rows[7 * i][1]} more {i}") for i in range(100)]
    looked = []
    real = near_copies._least_near
    near_copies._least_near = lambda *a: looked.append(1) or real(*a)
    try:
        found = near_copies.first_of_each(spark.createDataFrame(rows, DOC).repartition(8))
        assert sorted(r["doc_id"] for r in found.collect()) == list(range(1500))
    finally:
        near_copies._least_near = real
    assert len(looked) <= 2


def test_stage_keeps_other_texts_of_repeated_ids(spark):
    p, q = " ".join(f"p{i}" for i in range(50)), " ".join(f"q{i}" for i in range(50))
    rows = [(5, p, 1), (5, q, 1), (6, p, 2), (7, q, 3), (5, p, 1), (8, q + " more", 4), (9, "r " * 60_000, 5), (None, p, 6), (None, p, 6)]
    docs = spark.createDataFrame(rows, f"{DOC}, edition int").repartition(3)
    kept = near_copies.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"][0]) for r in kept.collect()) == [(-1, "p"), (-1, "p"), (5, "p"), (5, "q"), (9, "r")]
