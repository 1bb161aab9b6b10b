"""Running sums over ranges, AUC of many scores, bootstrap and nulls against plain versions."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veridex.functions.columns import incomplete_beta
from veridex.operators import evidence, metrics, nulls, ranks, resample, scoring
from veridex.sources import files

SF = "/root/testdata/sf0.001"


def plain_auc(scores, positive):
    order = np.argsort(scores, kind="stable")
    s, first = np.unique(scores[order], return_index=True)
    n = np.diff(np.r_[first, len(scores)])
    rank = np.repeat(first + (n + 1) / 2, n)
    p = positive[order]
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


@pytest.mark.parametrize("partitions", ["3", "7"])
def test_auc_of_half_a_million_distinct_scores(spark, partitions):
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    x = F.xxhash64("id") / F.lit(2.0**63)
    df = spark.range(0, 500_000, 1, 4).select(x.alias("s"), (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(100)) / 50.0 - 1 < x).alias("y"))
    pdf = df.toPandas()
    want = plain_auc(pdf["s"].to_numpy(), pdf["y"].to_numpy())
    assert pdf["s"].nunique() == 500_000
    for _ in range(2):
        assert abs(metrics.roc_auc(df, "s", F.col("y")).first()["auc"] - want) < 1e-12
    grouped = {r["g"]: r["auc"] for r in metrics.roc_auc(df.withColumn("g", F.col("s") > 0.3), "s", F.col("y"), ["g"]).collect()}
    assert abs(grouped[True] - plain_auc(*(pdf.loc[pdf["s"] > 0.3, c].to_numpy() for c in ("s", "y")))) < 1e-12
    spark.conf.set("spark.sql.shuffle.partitions", n)


def test_running_sums_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(np.round(v, 1)), i, int(w)) for i, (g, v, w) in enumerate(zip(rng.integers(0, 3, 400), rng.normal(size=400), rng.integers(0, 5, 400)))]
    df = spark.createDataFrame(rows, "g int, v double, i int, w long")
    found = {r["i"]: r["ahead"] for r in ranks.with_ahead(df, ["g"], "v", "w", ties=("i",)).collect()}
    assert found == {i: sum(w2 for g2, v2, i2, w2 in rows if g2 == g and (v2, i2) < (v, i)) for g, v, i, w in rows}
    assert ranks.with_ahead(df.limit(0), ["g"], "v").collect() == []


def test_positive_label_ignores_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), (None, "b")], "t string, p string")
    assert metrics.binary_metrics(df, "t", "p").count() == 1
    with pytest.raises(ValueError):
        metrics.binary_metrics(spark.createDataFrame([("a", "b"), ("c", None)], "t string, p string"), "t", "p")


def test_incomplete_beta():
    for n, k in ((10, 3), (41, 20), (300, 140)):
        for p in (0.1, 0.5, 0.73):
            terms = np.cumsum([1.0] + [0.0] * n)
            logs = [np.sum(np.log(np.arange(n - i + 1, n + 1))) - np.sum(np.log(np.arange(1, i + 1))) + i * np.log(p) + (n - i) * np.log1p(-p) for i in range(n + 1)]
            assert abs(incomplete_beta(k, n - k + 1, p) - np.exp(logs[k:]).sum()) < 1e-10 and len(terms)
    assert abs(2 * incomplete_beta(5 * 10**7 + 3000, 5 * 10**7 - 2999, 0.5) - 0.5485) < 1e-3  # 0.6 deviations


def test_pair_similarity_matches_all_pairs():
    rng = np.random.default_rng(2)
    masks = np.r_[rng.integers(0, 1 << 16, 60), rng.integers(0, 20, 60), [0, 0, 65535]]
    counts = np.bincount(masks, minlength=1 << 16).astype(float)
    j = [1.0 if not a | b else (a & b).bit_count() / (a | b).bit_count() for a, b in combinations(masks.tolist(), 2)]
    pairs, mean = evidence.pair_similarity(counts)
    assert pairs == len(j) and abs(mean - np.mean(j)) < 1e-9
    assert evidence.pair_similarity(np.bincount([5], minlength=1 << 16).astype(float)) == (0.0, None)


def items(spark, n=300):
    rng = np.random.default_rng(3)
    rows = [(i, int(m), int(e)) for i, (m, e) in enumerate(zip(rng.integers(1, 1 << 16, n), rng.integers(0, 1 << 16, n) & rng.integers(0, 1 << 16, n)))]
    return rows, spark.createDataFrame(rows, "image_id long, mask long, empty_mask long")


def test_nulls_follow_their_laws(spark):
    rows, df = items(spark)
    m, e = (np.array([r[i] for r in rows]) for i in (1, 2))
    bits = lambda x: np.array([(x >> c) & 1 for c in range(16)])
    hit = float(sum((int(a) & int(b)).bit_count() for a, b in zip(m, e)))
    cells = nulls.uniform_cells(df, 400, 5).first()
    want = sum(int(a).bit_count() * int(b).bit_count() / 16 for a, b in zip(m, e))
    assert cells["observed"] == hit and abs(cells["null_mean"] - want) < 0.02 * want and cells["replicates"] == 400
    for block, leaf in ((1 << 18, 1 << 14), (70, 20), (70, 0)):  # one block, and several, down to single sets
        shuffled = nulls.shuffled_items(df, 400, 5, block, leaf).first()
        want = (bits(m).sum(axis=1) * bits(e).sum(axis=1)).sum() / len(rows)
        assert shuffled["observed"] == hit and abs(shuffled["null_mean"] - want) < 0.01 * want
    rng = np.random.default_rng(6)
    plain = [sum((int(a) & int(b)).bit_count() for a, b in zip(m, rng.permutation(e))) for _ in range(400)]
    assert abs(shuffled["p_value"] - np.mean(np.array(plain) <= hit)) < 0.12
    sets = nulls.uniform_sets(df, 60, 5).first()
    draws = [evidence.pair_similarity(np.bincount([sum(1 << int(c) for c in rng.choice(16, int(x).bit_count(), replace=False)) for x in m], minlength=1 << 16).astype(float))[1] for _ in range(20)]
    assert abs(sets["null_mean"] - np.mean(draws)) < 0.01 and nulls.uniform_sets(df, 60, 5).first() == sets


def test_permuted_labels_follow_their_law(spark):
    rng = np.random.default_rng(7)
    x, g = rng.normal(size=500), rng.random(500) < 0.3
    df = spark.createDataFrame([(i, float(v), bool(b)) for i, (v, b) in enumerate(zip(x, g))], "k long, x double, g boolean")
    for block in (1 << 18, 60):
        r = nulls.permuted_labels(df, "x", "g", 2000, 9, block).first()
        observed = x[g].mean() - x[~g].mean()
        plain = [x[p := rng.permutation(g)].mean() - x[~p].mean() for _ in range(2000)]
        assert abs(r["observed"] - observed) < 1e-9 and abs(r["null_mean"]) < 0.02 and abs(r["p_value"] - np.mean(np.array(plain) >= observed)) < 0.05


def test_blocks_of_values_lie_in_tasks_of_their_own(spark):
    """They are few bytes, which Spark would coalesce into one task, before groups are made and after."""
    values = spark.range(4000).select(F.col("id").cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    dealt = nulls.in_blocks(values, 4)
    task = lambda key, pdf: pd.DataFrame({"block": [int(key[0])], "task": [TaskContext.get().partitionId()], "rows": [len(pdf)]})
    found = dealt.groupBy("block").applyInPandas(task, "block int, task int, rows long").collect()
    assert len(found) == 4 == len({r["task"] for r in found}) and sum(r["rows"] for r in found) == 4000


def test_bootstrap_of_any_metric(spark):
    rng = np.random.default_rng(8)
    rows = [(float(np.round(s, 1)), bool(s + rng.normal() > 0)) for s in rng.normal(size=400)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    share = {"share": lambda d: d.groupBy("b").agg((F.sum(F.col("w") * F.col("y").cast("int")) / F.sum("w")).alias("value")), "none": lambda d: d.groupBy("b").agg(F.lit(None).cast("double").alias("value"))}
    share["auc"] = lambda d: metrics.roc_auc(d, "s", F.col("y"), ["b"], F.col("w")).select("b", F.col("auc").alias("value"))
    found = {r["metric"]: r for r in metrics.bootstrap_ci(df, share, ["s", "y"], 300).collect()}
    p = np.mean([y for _, y in rows])
    low, high = p - 1.96 * np.sqrt(p * (1 - p) / 400), p + 1.96 * np.sqrt(p * (1 - p) / 400)
    assert abs(found["share"]["ci_low"] - low) < 0.015 and abs(found["share"]["ci_high"] - high) < 0.015
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    plain = [plain_auc(s[i], y[i]) for i in (rng.integers(0, 400, 400) for _ in range(300))]
    assert abs(found["auc"]["ci_low"] - np.quantile(plain, 0.025)) < 0.02 and found["none"]["replicates"] == 0


def test_matched_controls_of_every_size(spark):
    rng = np.random.default_rng(10)
    rows = [(k, sum(1 << int(c) for c in rng.choice(16, k, replace=False))) for k in range(17)]
    tissue = {k: np.round(rng.random(16) * 100, 1) for k in range(17)}
    coverage = spark.createDataFrame([(k, c, float(tissue[k][c])) for k in tissue for c in range(16)], "image_id long, cell_idx int, tissue_pct double")
    found = {r["image_id"]: r for r in resample.matched_control(spark.createDataFrame(rows, "image_id long, mask long"), coverage, 7).collect()}
    for k, mask in rows:
        others = [m for m in (sum(1 << c for c in cs) for cs in combinations(range(16), k)) if m != mask]
        if not others:
            assert found[k]["control_mask"] is None
            continue
        area = lambda m: sum(tissue[k][c] for c in range(16) if m >> c & 1)
        best = min((( m & mask).bit_count(), round(abs(area(m) - area(mask)), 6)) for m in others)
        assert (found[k]["overlap"], found[k]["tissue_gap"]) == best and found[k]["control_mask"].bit_count() == k


def test_only_tied_controls_are_written_out():
    """Of 560 sets a target those that tie alone, as one list column and not a list of Python's a target."""
    rng = np.random.default_rng(11)
    mask, tissue = np.array([sum(1 << int(c) for c in rng.choice(16, 9, replace=False)) for _ in range(30)]), rng.integers(0, 5, (30, 16)).astype(float)
    for masks in (mask, (1 << 16) - 1 - mask):
        overlap, gap, tied = resample.controls(masks, tissue)
        k = int(masks[0]).bit_count()
        assert str(tied.type) == "list<item: int64>" and len(tied) == 30
        area = lambda i, m: sum(tissue[i, c] for c in range(16) if m >> c & 1)
        for i, m in enumerate(masks.tolist()):
            near = [s for s in (sum(1 << c for c in cs) for cs in combinations(range(16), k)) if (s & m).bit_count() == overlap[i]]
            assert sorted(tied[i].as_py()) == sorted(s for s in near if abs(area(i, s) - area(i, m)) == gap[i])


@pytest.mark.parametrize("name", ["h2_uniform_sets", "h3_uniform_cells", "h4_shuffled_items", "h1_bootstrap_ci", "c12_matched_control_whole_sets"])
def test_queries_without_sql_run_on_the_tables(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert rows and all(r["replicates"] in (1000, 2000, 5000) for r in rows if "replicates" in r.asDict())


def test_annotations_that_break_their_contract_are_an_error(spark, tmp_path):
    rows = [("a", "HP", 1, "train"), ("a", "SSA", 9, "test")]
    spark.createDataFrame(rows, "image_id string, label string, ssa_votes int, partition string").write.option("header", True).csv(f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="duplicate_key"):
        files.read_annotations(spark, f"{tmp_path}/bad")
    spark.createDataFrame(rows[:1], "image_id string, label string, ssa_votes int, partition string").write.option("header", True).csv(f"{tmp_path}/good")
    assert files.read_annotations(spark, f"{tmp_path}/good", partition="train").count() == 1
    with pytest.raises(ValueError, match="empty"):
        files.read_annotations(spark, f"{tmp_path}/good", partition="test")


def test_interrupted_runs_pay_once(spark, tmp_path):
    requests = spark.createDataFrame([(f"{i:02d}", f"p{i}") for i in range(12)], "cache_key string, prompt string")
    cache, ledger = f"{tmp_path}/cache", f"{tmp_path}/ledger"
    first = scoring.score_run(requests, str.upper, cache, ledger, max_new=5)
    second = scoring.score_run(requests, str.upper, cache, ledger)
    assert first.count() == 5 and second.where("cache_hit").count() == 5 and second.where("NOT cache_hit").count() == 7
    again = [scoring.score_run(requests, str.upper, cache, ledger, run="third") for _ in range(2)]
    assert all(r.where("cache_hit").count() == 12 for r in again)
    assert files.committed_ledger(spark, ledger).count() == 17 + 12 and {r["answer"] for r in second.collect()} == {f"P{i}" for i in range(12)}


@pytest.mark.parametrize("few", [64, 1])
def test_stability_by_counts_equals_all_pairs(spark, monkeypatch, few):
    """One group with thousands of replicates, some with few, in both ways."""
    monkeypatch.setattr(evidence, "FEW_MASKS", few)
    rng = np.random.default_rng(12)
    rows = [("hot", i, int(m)) for i, m in enumerate(rng.integers(0, 1 << 16, 900))] + [("one", 0, 5), ("empty", 0, 0), ("empty", 1, 0)]
    rows += [("same", i, 7) for i in range(50)] + [("mixed", i, int(m)) for i, m in enumerate(rng.integers(0, 16, 40))]
    found = {r["g"]: r for r in evidence.replicate_stability(spark.createDataFrame(rows, "g string, replicate int, mask long"), ["g"], keep_single=True).collect()}
    for g in ("hot", "one", "empty", "same", "mixed"):
        m = [x for h, _, x in rows if h == g]
        j = [1.0 if not a | b else (a & b).bit_count() / (a | b).bit_count() for a, b in combinations(m, 2)]
        cited = [sum(x >> c & 1 for x in m) for c in range(16)]
        want = (len(m), np.mean(j) if j else 0.0, sum(k == len(m) for k in cited), sum(k == 1 for k in cited), sum(cited) / len(m))
        assert tuple(found[g][c] for c in ("n_reps", "mean_jaccard", "cells_in_all", "cells_in_one", "mean_cells")) == pytest.approx(want)
