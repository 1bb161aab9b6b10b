"""Exact draws against their laws, and nulls and bootstraps of any size."""

import hashlib
import math
from math import comb, sqrt

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veridex.functions import digests, draws
from veridex.operators import metrics, nulls


def law(good, bad, n):
    return np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) if 0 <= n - k <= bad and k <= good else 0.0 for k in range(n + 1)])


@pytest.mark.parametrize("few", [24, 2])
@pytest.mark.parametrize("good,bad,n", [(7, 5, 6), (60, 90, 70), (3, 200, 100), (40, 40, 79), (1, 1, 1)])
def test_hypergeometric_follows_its_law(monkeypatch, few, good, bad, n):
    monkeypatch.setattr(draws, "FEW", few)
    m, p = 40_000, law(good, bad, n)
    for i, x in enumerate((draws.hypergeometric(draws.generator(1), good, bad, np.full(m, n)), [draws.split(draws.generator(2, r), np.array([good, bad]), n)[0] for r in range(m // 8)])):
        seen = np.bincount(x, minlength=n + 1) / len(x)
        assert np.abs(seen - p).max() < 5 * sqrt(0.25 / len(x)), i


def test_split_of_many_kinds():
    counts = np.array([0, 5, 1, 900, 30, 64])
    x = np.array([draws.split(draws.generator(3, r), counts, 250) for r in range(4000)])
    assert (x.sum(axis=1) == 250).all() and (x <= counts).all() and (x >= 0).all()
    assert np.abs(x.mean(axis=0) - 250 * counts / 1000).max() < 0.5
    assert draws.split(draws.generator(3), counts, 1000).tolist() == counts.tolist() and not draws.split(draws.generator(3), counts, 0).any()
    with pytest.raises(ValueError):
        draws.split(draws.generator(3), counts, 1001)


def test_totals_beyond_a_billion():
    good, bad, n = 3 * 10**12, 7 * 10**12, 10**12
    x = draws.hypergeometric(draws.generator(4), good, bad, np.full(2000, n)).astype(float)
    p = good / (good + bad)
    sd = sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))
    assert abs(x.mean() - n * p) < 5 * sd / sqrt(2000) and abs(x.std() / sd - 1) < 0.08
    many = draws.split(draws.generator(5), np.full(1000, 10**13), 5 * 10**15)
    assert many.sum() == 5 * 10**15 and abs((many - 5 * 10**12).std() / sqrt(10**13 / 4) - 1) < 0.15


def test_blocks_agree_on_their_shares():
    sizes = np.array([5, 0, 100, 7, 3, 50, 1])
    n = np.arange(60, 166, 2)
    for take in (draws.hypergeometric, draws.binomial):
        shares = np.array([draws.share_of(b, sizes, n, 9, take) for b in range(len(sizes))])
        assert (shares.sum(axis=0) == n).all() and not shares[1].any()
    assert (np.array([draws.share_of(b, sizes, n, 9) for b in range(len(sizes))]) <= sizes[:, None]).all()
    each = np.array([draws.share_of(b, sizes, np.full(5000, 83), 10) for b in range(len(sizes))])
    assert np.abs(each.mean(axis=1) - sizes / 2).max() < 0.2


def test_bootstrap_weights_add_up(spark, monkeypatch):
    rows = spark.range(900).select((F.col("id") % 37).alias("x"), F.when(F.col("id") % 2 == 0, "a").alias("y"))
    for block, at_once in ((256, 1 << 18), (8, 64)):
        monkeypatch.setattr(metrics, "CELL_BLOCK", block)
        monkeypatch.setattr(metrics, "WEIGHTS", at_once)
        drawn = metrics.bootstrap_weights(rows, ["x", "y"], 1000, 3)
        sums = drawn.groupBy("b").agg(F.sum("w").alias("n"), F.min("w").alias("least")).collect()
        assert len(sums) == 1000 and {r["n"] for r in sums} == {900} and min(r["least"] for r in sums) == 1
        mean = {(r["x"], r["y"]): r["w"] / 1000 for r in drawn.groupBy("x", "y").agg(F.sum("w").alias("w")).collect()}
        held = {(r["x"], r["y"]): r["n"] for r in rows.groupBy("x", "y").agg(F.count("*").alias("n")).collect()}
        assert all(abs(mean[k] - n) < 6 * sqrt(n / 1000) for k, n in held.items())
        var = drawn.where("x = 5 AND y = 'a'").agg(F.sum(F.col("w") * F.col("w"))).first()[0] / 1000 - mean[5, "a"] ** 2
        n = held[5, "a"]
        assert abs(var / (n * (1 - n / 900)) - 1) < 0.25
    assert metrics.bootstrap_weights(rows.limit(0), ["x"], 10).collect() == []


def test_weights_dont_depend_on_partitions(spark):
    rows = spark.range(3000).select((F.col("id") % 700).cast("double").alias("x"))
    found = [sorted(map(tuple, metrics.bootstrap_weights(df, ["x"], 20, 1).collect())) for df in (rows, rows.repartition(7))]
    assert found[0] == found[1]


def test_failed_replicates_are_skipped(spark):
    """A mean of one rare row: replicates that don't draw it have no value."""
    rows = spark.createDataFrame([(1.0, True)] + [(0.0, False)] * 400, "x double, rare boolean")
    metric = {"rare": lambda d: d.groupBy("b").agg(F.avg(F.when(F.col("rare"), F.col("x"))).alias("value"))}
    r = metrics.bootstrap_ci(rows, metric, ["x", "rare"], 1000).first()
    assert 560 < r["replicates"] < 700 and r["ci_low"] == r["ci_high"] == 1.0  # 1 - 1/e


def test_permuted_labels_beyond_a_billion_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), bool(g), int(n)) for v, g, n in zip(rng.integers(0, 50, 400), rng.random(400) < 0.3, rng.integers(1, 10**8, 400))]
    df = spark.createDataFrame(rows, "x double, g boolean, n long")
    x, g, n = (np.array([r[i] for r in rows]) for i in range(3))
    r = nulls.permuted_labels(df, "x", "g", 2000, 2, block=16, count="n").first()
    n_in, total = int(n[g].sum()), int(n.sum())
    assert total > 10**10 and abs(r["observed"] - ((x * n)[g].sum() / n_in - (x * n)[~g].sum() / (total - n_in))) < 1e-9
    var = (n * x**2).sum() / total - ((n * x).sum() / total) ** 2
    sd = sqrt(var * total / n_in / (total - n_in))
    assert abs(r["null_mean"]) < 5 * sd / sqrt(2000) and r["p_value"] in (0.0, 1.0)


def test_shuffled_items_beyond_a_billion_items(spark):
    rng = np.random.default_rng(2)
    rows = [(int(m), int(e), int(n)) for m, e, n in zip(rng.integers(1, 1 << 16, 90), rng.integers(0, 1 << 16, 90), rng.integers(1, 10**9, 90))]
    df = spark.createDataFrame(rows, "mask long, empty_mask long, n long")
    for block in (1 << 18, 500):
        r = nulls.shuffled_items(df, 60, 3, block, count="n").first()
        m, e, n = (np.array([x[i] for x in rows]) for i in range(3))
        bits = lambda v: np.array([[(int(a) >> c) & 1 for a in v] for c in range(16)]) * n
        want = float((bits(m).sum(axis=1).astype(float) * bits(e).sum(axis=1) / n.sum()).sum())
        assert n.sum() > 10**10 and abs(r["null_mean"] / want - 1) < 1e-4 and r["replicates"] == 60
        assert r["observed"] == sum(bin(a & b).count("1") * k for a, b, k in rows)


def test_dealing_to_many_items_is_bounded_and_follows_its_law():
    """300 cited sets meet 40 empty ones; however many items there are, a replicate takes few numbers, with the spread of permutations."""
    rng = np.random.default_rng(4)
    cited, empty = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    masks, kinds = rng.choice(1 << 16, 300, replace=False), np.r_[rng.choice(1 << 10, 20, replace=False), (1 << 15) + rng.choice(1 << 6, 20, replace=False)]
    np.add.at(cited, rng.choice(masks, 3000), 1)
    np.add.at(empty, rng.choice(kinds, 3000), 1)
    plain = [int(nulls.POPCOUNT[np.repeat(np.arange(1 << 16), cited) & rng.permutation(np.repeat(np.arange(1 << 16), empty))].sum()) for _ in range(3000)]
    for block, leaf in ((1 << 18, 1 << 14), (1 << 18, 0), (3000, 30)):
        deal = nulls._Deal(cited, empty, 5, block, leaf)
        found = [sum(deal.hits(r, b) for b in range(1 << deal.depth)) for r in range(600)]
        assert abs(np.mean(found) - np.mean(plain)) < 5 * np.std(plain) / np.sqrt(600) and abs(np.std(found) / np.std(plain) - 1) < 0.15
    many = nulls._Deal(np.full(1 << 16, 10**6), empty * (1 << 16), 5, 1 << 18, 1 << 14)
    assert many.root.work < 17 * (1 << 17) and many.root.work < np.count_nonzero(empty) * (1 << 16) / 3


def test_digests_of_many_texts_equal_md5():
    rng = np.random.default_rng(2)
    texts = ["", "|", "é" * 30, *("|" + "x" * int(n) + str(i) for i, n in enumerate(rng.integers(0, 150, 200)))]
    for prefixes in ([b"42|0", b"42|7"], [b"7|10"], [b"42|999", b"42|100"], [b"-1234567|55"]):
        found = digests.Texts(pa.array(["cut off", *texts]).slice(1), len(prefixes[0])).heads(prefixes)
        assert found.tolist() == [[int(hashlib.md5(p + t.encode()).hexdigest()[:8], 16) for t in texts] for p in prefixes]


def plain_poisson_auc(rows: list[tuple], replicates: int, seed: int) -> list[float]:
    """Interval of (key, score, positive), a draw and a pair at a time; NaN is above all."""
    limits, values = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(6)], []
    for b in range(replicates):
        draws = [int(hashlib.md5("|".join([str(seed), str(b)] + [k] * (k is not None)).encode()).hexdigest()[:8], 16) / 2**32 for k, _, _ in rows]
        w = [(sum(u >= x for x in limits), (s != s, s), bool(t)) for u, (_, s, t) in zip(draws, rows, strict=True) if s is not None]
        w = [(n, (1, 0.0) if s[0] else s, t) for n, s, t in w]
        pairs = [(m * n, (s > r) + (s == r) / 2) for m, s, t in w if t for n, r, f in w if not f]
        if total := sum(n for n, _ in pairs):
            values.append(sum(n * x for n, x in pairs) / total)
    return [*np.percentile(values, [2.5, 97.5]), len(values)]


@pytest.mark.parametrize("kind", ["all different", "few", "odd"])
def test_auc_under_poisson_weights_equals_a_plain_one(spark, monkeypatch, kind):
    monkeypatch.setattr(metrics, "DRAWN_ROWS", 7)
    rng, nan = np.random.default_rng(4), float("nan")
    scores = {"all different": rng.random(60).tolist(), "few": rng.choice([0.25, 0.5], 60).tolist(), "odd": [0.0, -0.0, nan, None, nan, 1e300, -1e300, 2.0] * 8}[kind]
    rows = [(None if i % 11 == 5 else f"{i % 40}|x", s, [True, False, None][i % 3]) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "row_key string, s double, t boolean").repartition(3)
    found = metrics.bootstrap_auc(df, "s", F.col("t"), 12, 9).first()
    assert np.allclose(found, plain_poisson_auc(rows, 12, 9), rtol=1e-12, atol=0)


def test_weights_with_a_hash_are_drawn_for_a_thousand_replicates(spark, tmp_path):
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT i // 3 AS l_orderkey, i * 7 % 50 AS l_partkey, i % 10 AS l_suppkey, (i % 3)::INT AS l_linenumber, (i * 37 % 50)::DOUBLE AS l_quantity,
        CASE WHEN i % 2 = 0 THEN 'A' ELSE 'N' END AS l_returnflag FROM range(150) AS x(i)""")
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i * 5 % 8 AS o_custkey FROM range(50) AS x(i)")
    for name in ("lineitem", "orders"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    found = tuple(entry.queries()["h1_bootstrap_auc"](spark, str(tmp_path)).first())
    assert found[2] == 1000 and found == con.execute(entry.oracle_sql()["h1_bootstrap_auc"]).fetchone()


def test_rows_are_not_repeated_to_be_drawn(spark):
    rows = spark.createDataFrame([(str(i), float(i % 7), i % 3 == 0) for i in range(50)], "row_key string, s double, t boolean")
    found = metrics.bootstrap_auc(rows, "s", F.col("t"), 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in found and "explode" not in found
