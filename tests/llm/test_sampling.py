"""Mixing, whitening and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.llm import heat, importance, mixing, whitening
from veridex.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string"


# --- mixing ---


def plain_mix(docs, quality=None):
    """[(doc_id, source, size, source_size, target, taken)]"""
    rows = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in docs]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: mixing.RATIO[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(size.values())), list(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * size[s] < weight[s] * level]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= 3 * size[s]
            open_.remove(s)
    out = []
    for s in sources:
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, ahead = target[s] - epochs * size[s], 0

        def key(row):
            u = (int(hashlib.md5(f"42:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            return -math.log(u) / (quality or {}).get(row[0], 1.0), row[0] is not None, row[0] or 0, row[2]

        for i, _, n in sorted((r for r in rows if r[1] == s), key=key):
            out.append((i, s, n, size[s], target[s], n * (epochs + (ahead + n / 2 <= rest))))
            ahead += n
    return out


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choice([0, 1, 5, 30, 200])
        rows.append((i, " \t\n\x0b".join("ab é"[: rng.randint(1, 4)].strip() or "x" for _ in range(words)), rng.choice(["hot", "hot", "hot", "a", "é", "zz", "empty", None])))
    rows = [(i, "" if s == "empty" else t, s) for i, t, s in rows]
    return rows + [(n, None, "hot"), (n, "again", "hot"), (n, "again", "hot"), (None, "nobody " * 40, None), (n + 1, "w " * 30_000, "a")]


def test_mix_equals_definition(spark, monkeypatch):
    docs = corpus()
    quality = {i: 0.25 + (i % 7) for i in range(0, 400, 3)}
    table = spark.createDataFrame(docs, DOCS).withColumns({"size": F.lit("clash"), "key": F.lit(1), "target": F.lit(2)})
    weights = spark.createDataFrame([(i, q) for i, q in quality.items()] + [(None, 9.0)], "doc_id long, quality double")
    for cells, most in ((4096, 2000), (3, 2)):
        monkeypatch.setattr(mixing, "CELLS", cells)
        monkeypatch.setattr(heat, "MOST", most)
        for q, plain in ((None, None), (weights, quality)):
            found = [tuple(r) for r in mixing.mix(table.repartition(5), q).collect()]
            assert Counter(found) == Counter(plain_mix(docs, plain))


def test_mix_meets_its_targets(spark):
    docs = corpus(2, 1500)
    found = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    by = {}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert math.isclose(sum(rows[0]["target"] for rows in by.values()), sum(r["size"] for r in found))
    for rows in by.values():
        assert rows[0]["target"] <= 3 * rows[0]["source_size"]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2
        if rows[0]["target"] >= rows[0]["source_size"]:  # a complete epoch comes first
            assert all(r["taken"] >= r["size"] for r in rows)


def test_better_documents_come_first(spark):
    docs = [(i, "w " * 10, s) for i in range(4000) for s in ("a", "c")]
    quality = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0) for i in range(4000)], "doc_id long, quality double")
    found = mixing.mix(spark.createDataFrame(docs, DOCS), quality).where("source = 'c' AND taken > 0").collect()
    share = sum(r["doc_id"] % 2 for r in found) / len(found)
    assert 0.6 < share < 0.8  # 4000 * 4 / 7 words of 10 are taken; the good half goes faster


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None), (1, " ", "a")], DOCS)).collect()] == [0, 0]


def test_mixing_needs_no_python_workers(spark):
    plan = QUERIES["op11_mixing"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|MapPartitions|Pandas", plan)


# --- whitening ---


def plain_whiten(vectors):
    """(n, deviations, values, vectors of the covariance, trace) of the usable rows."""
    x = np.floor(np.array(vectors, dtype=float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    return n, (y * y).sum(axis=1), values[::-1], axes[:, ::-1], c


def compare(found, ids, vectors, most=8):
    n, deviation, values, axes, c = plain_whiten(vectors)
    rank = int((values > 1e-12 * max(values[0], 1e-300)).sum()) if n else 0
    k = min(most, rank)
    assert len(found) == n * k
    of = {}
    for r in found:
        of.setdefault(r["vec_id"], {})[r["component"]] = r
    w = np.array([[of[i][j]["whitened"] for j in range(1, k + 1)] for i in ids])
    assert [of[i][1]["deviation"] for i in ids] == deviation.tolist() and {r["n"] for r in found} == {n}
    for j in range(k):
        assert math.isclose(of[ids[0]][j + 1]["explained"], values[j] / values.sum(), rel_tol=1e-9)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6
    # directions that belong to the values: V a = e a, for a = sum of w c, which is n * sqrt(e) * the direction
    back = c.T @ w / n / np.sqrt(values[:k])
    assert np.abs(c.T @ (c @ back) / n - back * values[:k]).max() < 1e-7 * values[0]
    assert {r["identity_error"] for r in found} < {*[r["identity_error"] for r in found], 1.0} and max(r["identity_error"] for r in found) < 1e-6


@pytest.mark.parametrize("fan_in", [32, 2])
def test_whitening_equals_eigenvectors(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((700, 24)) * np.linspace(3, 0.1, 24) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(9000, None), (9001, [math.nan] * 24), (9002, [None, *[0.0] * 23]), (9003, [math.inf] * 24), (9004, []), (9005, [1.0] * 3)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"n": F.lit("clash"), "w": F.lit(0), "vector": F.lit(1)})
    compare(whitening.whiten(df.repartition(9)).collect(), list(range(700)), vectors)


def test_whitening_of_equal_values_and_low_ranks(spark):
    schema = "vec_id long, embedding array<float>"
    square = np.vstack([np.eye(12), -np.eye(12)])
    copies = np.repeat(np.random.default_rng(1).standard_normal((4, 16)), 60, axis=0)
    for vectors in (square, copies, square[:2], np.array([[1.0], [2.0], [4.0]])):
        found = whitening.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], schema)).collect()
        compare(found, list(range(len(vectors))), np.float32(vectors))
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_whitening_of_repeated_rows(spark):
    rows = [(1, [1.0, 2.0])] * 2 + [(None, [0.0, 5.0]), (2, [3.0, 1.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(r["vec_id"] for r in found) == {1: 4, None: 2, 2: 2}


def test_deviations_beyond_a_long(spark):
    rows = [(0, [0.0]), (1, [2.0**30])]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {0: None, 1: None}  # (2 ** 40) ** 2


def test_values_of_bidiagonal_matrices():
    rng = np.random.default_rng(7)
    for d in (1, 2, 3, 17, 64):
        for scale in (np.ones(d), np.logspace(0, -9, d), np.logspace(-9, 0, d)):
            r = np.triu(rng.standard_normal((d, d))) * scale
            a, b, v = whitening.bidiagonalise(r)
            assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
            full = np.diag(a) + np.diag(b, 1) if d > 1 else np.diag(a)
            assert np.allclose(np.linalg.svd(full, compute_uv=False), np.sqrt(whitening.dqds(a, b)), rtol=1e-6, atol=1e-13)
    assert whitening.dqds(np.array([0.0, 0.0, 3.0]), np.array([1.0, 2.0]))[-1] < 1e-25
    # small values keep their digits: 1e-8 beside 1
    assert math.isclose(whitening.dqds(np.array([1.0, 1e-8]), np.array([0.0]))[1], 1e-16, rel_tol=1e-12)


# --- importance resampling ---


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent=5):
    feats = [plain_features(t) for _, t in docs]
    raw, wanted = Counter(b for _, f in feats for b in f), Counter(b for t in target for b in plain_features(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((raw[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows = []
    for (i, _), (n, f) in zip(docs, feats, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "É", "straße", "x1", "日本", "a" * 70, "B" * 200, *[f"w{i}" for i in range(50)]]
    return [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 60]))) + rng.choice(["", ".", "\x00-", " "])) for i in range(n)]


def test_resample_equals_definition(spark, monkeypatch):
    docs = prose(3, 900) + [(1, "w1 w2 " * 20)] * 3 + [(None, "w3 " * 30), (5000, None), (5001, ""), (5002, "w4 beta " * 6000)]
    target = ["w1 w2 w3 beta " * 9, "Alpha w9", None, ""]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"weight": F.lit("clash"), "segment": F.lit(1), "file": F.lit("x")}).repartition(6)
    wanted = plain_resample(docs, target)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for step, segments, percent in ((1 << 18, (256, 8192), 5), (7, (4, 8), 5), (1000, (2, 2), 60)):
        monkeypatch.setattr(importance, "STEP", step)
        monkeypatch.setattr(importance, "SEGMENTS", segments)
        found = importance.resample(table, goal, percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert Counter(map(tuple, found)) == (wanted if percent == 5 else plain_resample(docs, target, percent))


def test_resample_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).collect() == []
    few = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample(few, empty).collect()] == [None, None]


def test_equal_scores_are_split(spark, monkeypatch):
    """A third of all rows with one key lies in several segments."""
    monkeypatch.setattr(importance, "SEGMENTS", (16, 16))
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "20L AS n_words", "57L AS n_features", "0L AS weight", "CASE WHEN id % 3 = 0 THEN 500 ELSE id % 400 END AS score")
    found = importance.ranked(rows.repartition(5), lambda n: n)
    assert [r["rank"] for r in found.orderBy("rank").collect()] == list(range(1, 3001))
    assert found.where("doc_id = 7 AND score = 500").agg(F.max("rank")).first()[0] == 1000
    by = [tuple(r) for r in found.orderBy("rank").select("score", "doc_id").collect()]
    assert by == sorted(by, key=lambda r: (-r[0], r[1]))


def test_crcs_of_runs():
    words = ["a", "é" * 40, "x" * 64, "y" * 65, "z" * 300, "b", "日本"]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = ends - [len(w.encode()) for w in words]
    for k, got in enumerate(importance.run_crcs(data, starts, ends)):
        assert got.tolist() == [zlib.crc32(" ".join(words[i : i + k + 1]).encode()) for i in range(len(words) - k)]


def test_registered_queries_equal_definitions(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    found = QUERIES["op13_importance"](spark, SMALL).collect()
    assert Counter(map(tuple, found)) == plain_resample([d[:2] for d in docs], target)
    quality = {r["doc_id"]: (0.5, 2.0)[r["quality"]] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    found = QUERIES["op11_mixing"](spark, SMALL).collect()
    assert Counter(map(tuple, found)) == Counter((i, n, s, t, k) for i, _, n, s, t, k in plain_mix(docs, quality))
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    compare(QUERIES["op12_whitening"](spark, SMALL).collect(), [r["vec_id"] for r in vectors], np.float32([r["embedding"] for r in vectors]))
