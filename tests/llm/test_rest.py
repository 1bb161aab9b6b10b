"""URL filters, nearest neighbours, sharding, and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veridex.llm import ann, heat, queries, sharding, url_filter
from veridex.llm.queries import URL_RULES

SMALL = "/root/testdata/sf0.01"

RULES = "host string, path string, verdict string"


def plain_verdict(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "http://x.net", "http://x.net/", "HTTP://A.Example.NET/en/x?y#z", "http://net/a", "http://xnet/a", "ftp://example.com/de", "ftp://example.com/de/", "http://www.example.com/de/1#/",
    "x://b.org/fr/..", "http://é.org/fr/é?q", "http://a.b.example.net?x/en/", "http://u@h.net:80/p", "http://.net/", "a://b://c.net/", "http://example.net/EN/", "http://x.net/a\nb",
]


def test_urls_match_definition(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    for rules in (URL_RULES, [], URL_RULES + [("c.net", "/", "allow"), ("x.net", "/a", "block"), ("x.net", "", "allow")]):
        found = url_filter.judge(pages, spark.createDataFrame(rules, RULES)).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(str((i, *plain_verdict(u, rules))) for i, u in [*enumerate(URLS), (0, None)])


@pytest.mark.parametrize("most", [2000, 2])
def test_urls_of_a_hot_host(spark, monkeypatch, most):
    monkeypatch.setattr(heat, "MOST", most)
    urls = [*URLS, *["http://hot.net/x"] * 60, *["http://cold.com/x"] * 60, *[None] * 30]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = url_filter.judge(pages, spark.createDataFrame(URL_RULES, RULES)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, *plain_verdict(u, URL_RULES))) for i, u in enumerate(urls))


def test_urls_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    found = url_filter.judge(pages, spark.createDataFrame(URL_RULES + [(None, "/", "block")], RULES)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, *plain_verdict(u, URL_RULES))) for i, u in enumerate(URLS))
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(URL_RULES, RULES)).collect() == []


def vectors(spark, n=900, dim=8, seed=15):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:400] = x[100]  # a hot vector
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


@pytest.mark.parametrize("block_rows", [40, 300])
def test_neighbours_recall_and_scores(spark, block_rows):
    rows, df = vectors(spark)
    found = ann.search(df, F.col("vec_id") % 20 == 0, k=10, block_rows=block_rows, chunk_rows=20).collect()
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x = x.astype(np.float32).astype(np.float64)
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 900, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        own = sorted(by[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in own)
        assert own == sorted(own, key=lambda z: (-z[2], z[1])) or [v for _, v, _ in own] == [v for _, v, _ in sorted(own, key=lambda z: (-z[2], z[1]))]
        bar = np.sort(scores)[-10]
        hit += sum(scores[v] >= bar - 1e-9 for _, v, _ in own)
    assert hit >= 0.9 * 450


def plain_neighbours(rows, k=20):
    """query row -> the k best other rows, by definition: (query_id, rank, vec_id, score)."""
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = []
    for i, (q, _) in enumerate(rows):
        if q % 20 == 0:
            s = x @ x[i]
            best = sorted((-float(s[j]), rows[j][0]) for j in range(len(rows)) if j != i)[:k]
            out += [(q, r + 1, v, -n) for r, (n, v) in enumerate(best)]
    return out


def test_neighbours_of_repeated_rows_are_exact(spark):
    rng = np.random.default_rng(20)
    rows = [(i % 25, [float(a) for a in np.round(rng.normal(size=4), 1)]) for i in range(40)]
    rows += [(60, rows[0][1])] * 30 + [(100 + i, rows[0][1]) for i in range(30)] + [(7, rows[1][1]), (0, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = sorted((r[0], r[1], r[2], round(r[3], 9)) for r in ann.search(df, F.col("vec_id") % 20 == 0, probe_share=1.0).collect())
    assert found == sorted((q, r, v, round(s, 9)) for q, r, v, s in plain_neighbours(rows))


def test_near_copies_beyond_rerank_are_all_compared(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(size=16)
    rows = [(i, [float(a) for a in base + 1e-9 * rng.normal(size=16)]) for i in range(1500)] + [(2000 + i, [float(a) for a in rng.normal(size=16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id").isin(0, 20)).collect()
    x = np.array([v for _, v in rows])
    for q in (0, 20):
        bar = np.sort(np.delete(x @ x[q], q))[-20]
        assert sum(r["score"] >= bar - 1e-15 for r in found if r["query_id"] == q) >= 18


@pytest.mark.parametrize("noise", [1e-3, 1e-2])
def test_recall_beside_near_copies(spark, noise):
    """Random vectors keep their recall beside two groups of near copies, and so do these."""
    rng = np.random.default_rng(22)
    x = rng.normal(size=(6500, 64)).astype(np.float32)
    for at in (1500, 4000):
        x[at : at + 2500] = x[at] + noise * rng.normal(size=(2500, 64))
    order = rng.permutation(len(x))
    x = x[order]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    right = {True: [], False: []}
    wide = x.astype(np.float64)
    for q in range(0, len(x), 20):
        s = wide @ wide[q]
        s[q] = -np.inf
        right[bool(order[q] < 1500)].append(len(set(np.argsort(-s, kind="stable")[:20].tolist()) & found[q]) / 20)
    assert np.mean(right[True]) >= 0.9 and np.mean(right[False]) >= 0.9, {k: np.mean(v) for k, v in right.items()}


def test_registered_neighbours_query_reaches_the_recall(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect() if r["embedding"] is not None]
    want, found = {}, {}
    for q, _, v, _ in plain_neighbours(rows):
        want.setdefault(q, set()).add(v)
    for r in queries.QUERIES["op4_ann"](spark, SMALL).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == set(want) and all(len(f) == 20 for f in found.values())
    assert sum(len(want[q] & found[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.25]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash"))
    found = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]
    assert ann.search(df.limit(0), F.lit(True)).collect() == []


def test_blocks_hold_whole_lists_and_parts_of_large_ones():
    first, parts, blocks = ann.blocks_of(np.array([3, 4, 0, 25, 5, 9]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1] and blocks == 6


def plain_shards(keys, shards, virtual):
    """Bounded loads by definition, key by key, for the same order of offers."""
    points = sharding.ring_points(shards, virtual)
    import hashlib
    from bisect import bisect_left

    places = [p for p, _ in points]
    place = lambda k: int(hashlib.md5(k.encode()).hexdigest()[:13], 16)
    arcs = {}
    for k in sorted(keys, key=lambda k: (place(k), int(k))):
        arcs.setdefault(bisect_left(places, place(k)) % len(places), []).append(k)
    room = {s: len(keys) // shards + (s < len(keys) % shards) for s in range(shards)}
    left, out = {a: list(ks) for a, ks in arcs.items()}, {}
    for k in range(shards):
        for arc in range(len(points)):
            s = sharding.preference(points, arc)[k]
            while left.get(arc) and room[s]:
                out[left[arc].pop(0)] = s
                room[s] -= 1
    return out


def test_shards_match_definition(spark):
    rows = [(i * 7, "x" * (i % 5)) for i in range(500)]
    found = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 6, 5).collect()
    assert {str(r["doc_id"]): r["shard"] for r in found} == plain_shards([str(d) for d, _ in rows], 6, 5)
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    text = dict(rows)
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in found)


def test_shards_edges(spark):
    rows = [(None, "é"), (1, None), (1, None), (1, "a")]
    found = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))).collect()
    assert len({r["shard"] for r in found}) == 4 and sorted(r["size"] for r in found) == [8, 8, 9, 10]
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_most_keys_stay_home_when_a_shard_is_added(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 8, 128).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 9, 128).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


def test_shards_of_very_long_texts(spark):
    rows = [(i, "é" * 200_000 if i == 3 else "x") for i in range(40)]
    found = {r["doc_id"]: r for r in sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4, 8).collect()}
    assert found[3]["size"] == 400_008 and found[3]["text_crc32"] == zlib.crc32(("é" * 200_000).encode())
    assert sorted(Counter(r["shard"] for r in found.values()).values()) == [10, 10, 10, 10]


def test_pipeline_edges(spark, tmp_path):
    rng = random.Random(28)
    words = ["the", "thing", "where", "other", "within", "which"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(n))
    a, long, item = text(60), text(20_000), text(12)
    rows = [(i, text(50), "en", None, None) for i in range(20)]
    rows += [(30, a, "en", "s", 1), (30, a, "en", "s", 1), (31, a, "en", "s", 1), (30, text(60), None, "s", 1), (None, text(40), "en", "s", 1), (32, long, "en", "s", 1), (33, long + " end", "en", "s", 1)]
    rows += [(34, None, None, None, None), (35, "", "en", "s", 0), (36, f"{long} {item}", "en", "s", 1), (37, text(30) + " " + "z" * 100_000, "en", "s", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = ("row", "hits", "spans", "ids", "score", "edition", "node", "key")
    docs = spark.createDataFrame([(*r, *clash) for r in rows], names + "".join(f", {c} string" for c in clash)).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns and out.select(*clash).distinct().count() == 1
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r["doc_id"] for r in found)
    assert ids == Counter({**{i: 1 for i in range(20)}, 30: 2, None: 1, 32: 1, 37: 1})
    assert {r["decoded"] for r in found if r["doc_id"] == 32} == {long}


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(16)
    words = {"en": ["the", "thing", "where", "other", "within", "which"], "fr": ["le", "était", "où", "être", "nous", "eux"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randint(0, 99)) for _ in range(n))
    rows = [(i, text(lang, 60), lang, "s", 0) for i in range(60) for lang in [("en", "fr")[i % 2]]]
    leak = text("en", 12)
    rows += [(100, rows[0][1], "en", "s", 0), (101, "12 34 !", "en", "s", 0), (102, f"{text('en', 20)} {leak} {text('en', 9)}", "en", "s", 0), (103, text("en", 30) + " token=abcdefgh12", "en", "s", 0), (104, None, "en", "s", 0)]
    docs = spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {r[0] for r in rows} - {100, 101, 102, 104}
    assert found[103]["decoded"].endswith(" [secret]") and found[103]["n_chars"] == len(found[103]["decoded"])
    assert found[3]["decoded"] == rows[3][1]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
