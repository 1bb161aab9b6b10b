"""Hand-checked cases of operators, and the traps of their definitions."""

import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridex.functions import columns as C
from veridex.operators import answers, contrast, evidence, ledger, metrics, resample, scoring, wording
from veridex.sources import files
from veridex.streaming import calls

RUN = "image_id long, label string, label_pred string, confidence double"


def value(df):
    return df.collect()[0][0]


def test_published_sign_tests(spark):
    rows = spark.createDataFrame([(7, 11), (13, 1), (8, 5), (6, 0), (0, 0), (4000, 4000)], "a long, b long")
    p = [r[0] for r in rows.select(C.sign_test("a", "b")).collect()]
    assert [round(x, 4) for x in p[:3]] == [0.4807, 0.0018, 0.5811] and p[3:] == pytest.approx([0.03125, 1.0, 1.0])


def test_bin_edges_are_not_multiples(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (0.7,), (1.0,), (0.0,), (0.1,)], "c double")
    assert [r[0] for r in df.select(metrics.bin_of(F.col("c"), 10)).collect()] == [2, 5, 6, 9, 0, 1]


def test_ece_needs_confidences_in_range(spark):
    good = spark.createDataFrame([(1, "a", "a", 0.9), (2, "a", "b", 0.9)], RUN)
    assert abs(value(metrics.ece(good)) - 0.4) < 1e-12
    assert value(metrics.ece(good.withColumn("confidence", F.lit(1.5)))) is None
    curve = metrics.reliability_curve(good).orderBy("bin").collect()
    assert len(curve) == 10 and curve[9]["n"] == 2 and curve[0]["accuracy"] is None


def test_auc_ties_single_class_and_symmetry(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.9, 1)], "s double, y int")
    auc = value(metrics.roc_auc(df, "s", F.col("y") == 1))
    assert auc == 0.875
    assert abs(value(metrics.roc_auc(df.withColumn("s", 1 - F.col("s")), "s", F.col("y") == 1)) - (1 - auc)) < 1e-12
    assert value(metrics.roc_auc(df.where("y = 1"), "s", F.col("y") == 1)) is None


def test_metrics_of_nothing_are_zero(spark):
    df = spark.createDataFrame([("HP", "HP"), ("SSA", "HP")], "t string, p string")
    r = metrics.binary_metrics(df, "t", "p").collect()[0]
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    with pytest.raises(ValueError):
        metrics.binary_metrics(df.where("t = 'HP'"), "t", "p")


def test_binomial_interval(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (10, 10)], "k long, n long")
    rows = [(round(r["ci_low"], 4), round(r["ci_high"], 4)) for r in metrics.binomial_ci(spark, df, "k", "n").collect()]
    assert rows == [(0.0, 0.3085), (0.1871, 0.8129), (0.6915, 1.0)]


def test_empty_sets_are_alike(spark):
    one = spark.range(1)
    assert value(one.select(C.jaccard_masks(F.lit(0), F.lit(0)))) == 1.0
    assert value(one.select(C.jaccard_arrays(F.array().cast("array<int>"), F.array(F.lit(1))))) == 0.0


def test_seeded_numbers_are_fixed(spark):
    got = [r[0] for r in spark.range(3).orderBy("id").select(C.u(7, "id")).collect()]
    assert got == [0.27568049542605877, 0.1117505265865475, 0.42845136811956763]


def test_dedup_first_and_last(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 5)], "k long, v string, seq long")
    assert sorted(r["v"] or "" for r in ledger.dedup(df, ["k"], "first").collect()) == ["", "a"]
    assert sorted(r["v"] or "" for r in ledger.dedup(df, ["k"], "last").collect()) == ["", "b"]
    with pytest.raises(ValueError):
        ledger.dedup(df, ["k"], "any")


def test_resume_policies_differ(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "image_id long")
    done = spark.createDataFrame([(1, False, "HP"), (2, True, None), (3, False, None)], "image_id long, failed boolean, predicted_label string")
    left = {p: sorted(r[0] for r in ledger.pending(jobs, done, ["image_id"], p).collect()) for p in ledger.DONE}
    assert left == {"any": [4], "no_error": [2, 4], "no_error_and_parsed": [2, 3, 4]}


RAW = [
    ('{"a": 1}', '{"a": 1}', None), ('x ```json\n{"a": "}"}\n``` {', '{"a": "}"}', None), ('pre {"a": {"b": "\\"}"}} tail }', '{"a": {"b": "\\"}"}}', None),
    ("none", None, "no opening brace"), ('{"a": "}', None, "unbalanced braces"), (None, None, "no opening brace"), ('{"a": 1} trailing', '{"a": 1}', None),
]


def test_extract_json(spark):
    df = spark.createDataFrame([(r[0],) for r in RAW], "raw string")
    assert [tuple(r[0]) for r in df.select(answers.extract_json("raw")).collect()] == [r[1:] for r in RAW]


ANSWERS = {
    "good": '{"label": "HP", "confidence": 0.5, "evidence": [{"feature": "stroma", "grid_cells": ["A1"], "description": "x"}]}',
    "bool": '{"label": "HP", "confidence": true, "evidence": []}',
    "case": '{"label": "HP", "confidence": 1, "evidence": [{"feature": "stroma", "grid_cells": [" a1", "Z9"], "description": "x"}]}',
    "keys": '{"label": "HP", "confidence": 1, "evidence": [], "more": 1}',
    "blank": '{"label": "XX", "confidence": 2, "evidence": [{"feature": "foo", "grid_cells": [], "description": " "}]}',
    "broken": "{",
}


def test_lenient_and_strict_validation(spark):
    df = spark.createDataFrame(list(ANSWERS.items()), "name string, payload string")
    out = {s: {r["name"]: r for r in answers.validate(df, "payload", answers.Protocol(), strict=s).collect()} for s in (False, True)}
    assert {n for n, r in out[False].items() if not r["violations"]} == {"good", "keys"}
    assert {n for n, r in out[True].items() if not r["violations"]} == {"good"}
    assert out[False]["bool"]["violations"] == ["confidence boolean"] and out[False]["bool"]["parsed"]["confidence"] is None
    item = out[False]["case"]["parsed"]["evidence"][0]
    assert (item["grid_cells_valid"], item["grid_cells_invalid"]) == (["A1"], ["Z9"])
    assert out[True]["case"]["parsed"]["evidence"][0]["grid_cells_invalid"] == [" a1", "Z9"]
    assert {v.split()[0] for v in out[False]["blank"]["violations"]} == {"label", "confidence", "feature", "cells", "description"}
    assert out[False]["broken"]["parsed"] is None


def test_stability_keeps_or_drops_single_replicates(spark):
    masks = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 1, 0)], "g string, replicate int, mask long")
    assert [tuple(r) for r in evidence.replicate_stability(masks, ["g"]).collect()] == [("a", 2, 0.5, 1, 1, 1.5)]
    probe = evidence.stability_probe(masks, ["g"]).collect()[0]
    assert (probe["groups"], probe["mean_jaccard"], probe["core_share"]) == (2, 0.25, 0.5)


def test_between_items_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 32, 60).tolist()
    pairs = [1.0 if a | b == 0 else (a & b).bit_count() / (a | b).bit_count() for i, a in enumerate(m) for b in m[i + 1 :]]
    got = evidence.between_item_similarity(spark.createDataFrame([(x,) for x in m], "mask long")).collect()[0]
    assert got["n_pairs"] == len(pairs) and abs(got["mean_jaccard"] - np.mean(pairs)) < 1e-12


def test_full_targets_have_no_control(spark):
    targets = spark.createDataFrame([(1, (1 << 16) - 1), (2, 1)], "image_id long, mask long")
    coverage = spark.createDataFrame([(i, c, float(c)) for i in (1, 2) for c in range(16)], "image_id long, cell_idx int, tissue_pct double")
    found = {r["image_id"]: r for r in resample.matched_control(targets, coverage, 7).collect()}
    assert found[1]["control_mask"] is None and found[2]["control_mask"] == 2 and found[2]["tissue_gap"] == 1.0
    random = {r["image_id"]: r for r in resample.random_control(targets, 7).collect()}
    assert random[2]["overlap"] == 0 and random[1]["overlap"] == 16


def test_null_draws_keep_sizes_and_ranges(spark):
    masks = spark.createDataFrame([(i, (1 << (i % 5)) - 1) for i in range(30)], "image_id long, mask long")
    coverage = spark.createDataFrame([(i, c, 0.0 if c == i % 16 else 50.0) for i in range(30) for c in range(16)], "image_id long, cell_idx int, tissue_pct double")
    drawn = resample._drawn(masks.withColumn("size", F.bit_count("mask")), 2, 3, "size", ["image_id"]).collect()
    assert all(r["drawn_mask"].bit_count() == r["size"] for r in drawn)
    for null in (resample.uniform_cell_null(masks, coverage, 3, 1, ["image_id"]), resample.shuffled_item_null(masks, coverage, 3, 1)):
        assert 0 <= null.collect()[0]["p_value"] <= 1


def test_block_shuffle_reports_lost_area(spark):
    blocks = spark.createDataFrame([(1, 0, 5, 0.1), (1, 1, 4, 0.9), (1, 2, 0, 0.2)], "image_id long, block int, masked long, tissue_share double")
    found = resample.block_shuffle(blocks, 1).orderBy("moved_from").collect()
    assert [r["lost"] for r in found] == [False, True] and found[0]["moved_to"] == 1


def test_descriptions(spark):
    texts = ["Serration in the UPPER part", "extends deep", "throughout the crypts", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0]["direction"] for r in df.select(wording.classify_location("t")).collect()] == ["HP", "SSA", "SSA", "none", "none"]
    denied = spark.createDataFrame([("straight crypts without the basal dilation",), ("boot-shaped",)], "t string")
    assert [r[0]["direction"] for r in denied.select(wording.classify_architecture("t")).collect()] == ["HP", "SSA"]
    assert value(denied.where("t = 'boot-shaped'").select(wording.criterion_terms("t"))) == ["boot-shaped"]
    assert value(spark.range(1).select(wording.content_tokens(F.lit("The crypts show it, crypts OK x")))) == ["crypts"]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string"), spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, t string")
    assert sorted(map(tuple, wording.drift(old, new, "k", "t").collect())) == [(2, "changed"), (3, "new")]


def test_files(spark, tmp_path):
    (tmp_path / "tiles").mkdir()
    (tmp_path / "tiles" / "a.png").write_bytes(b"x")
    assert [r[0] for r in files.file_names(spark, str(tmp_path / "tiles")).collect()] == ["a.png"]
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n\n{"k": 2}\nbad\n')
    path = str(tmp_path / "l.jsonl")
    assert files.read_ledger(spark, path, "k long", "skip").count() == 2
    assert files.read_ledger(spark, path, "k long", "keep").select("*").toPandas()["_corrupt_record"].notna().sum() == 1
    with pytest.raises(Exception):  # noqa: B017
        files.read_ledger(spark, path, "k long", "fail").collect()
    cells = spark.createDataFrame([(1, "A1", 3.0, True), (1, "A2", 9.0, False)], "image_id long, cell string, tissue_pct double, is_empty boolean")
    files.write_coverage(cells, str(tmp_path / "cov"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cov" / "index")).first()["n_empty"] == "1"
    bad = spark.createDataFrame([([1.0], None)], "v array<float>, label int")
    with pytest.raises(ValueError):
        files.save_embeddings(bad, str(tmp_path / "e"), "v", "label", 1)


def test_score_batch_caps_new_calls_and_keeps_errors(spark):
    requests = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("a", "1")], "cache_key string, prompt string")
    found = {r["cache_key"]: r for r in scoring.score_batch(requests, lambda p: str(int(p) + 1), max_new=2).collect()}
    assert set(found) == {"a", "b"} and found["a"]["answer"] == "2" and found["b"]["error"].startswith("ValueError")


def test_probe_learns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4) + 4 * (i % 2)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    out = scoring.probe_scores(scoring.linear_probe(df, "v", "label"), df, "v", "label", "id")
    assert value(out.agg(F.avg((F.col("label") == F.col("predicted")).cast("int")))) > 0.95
    assert value(spark.createDataFrame([([1.0, 1.0], 0)], "z array<double>, k int").select(metrics.softmax_loss("z", "k"))) == pytest.approx(math.log(2))


def test_baseline_null_confidence_counts_as_zero(spark):
    df = spark.createDataFrame([(1, "HP", None, "SSA", 0.5, "x")], "image_id long, label_pred string, confidence double, base_label string, base_confidence double, arm string")
    r = contrast.arm_summary(df, ["arm"]).collect()[0]
    assert (r["flips"], r["mean_abs_dconf"]) == (1, 0.5)


def test_stream_routes_and_survives_repeats(spark, tmp_path):
    schema = "experiment string, image_id long, failed boolean, predicted_label string, input_tokens long, output_tokens long"
    rows = [("e", 1, False, "HP", 1, 1), ("e", 1, False, "HP", 1, 1), ("e", 2, True, None, 1, 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: calls.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    calls.ingest_calls(stream(), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    q = calls.stream_dedup(stream(), ["experiment", "image_id"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1


def test_running_cost_counts_calls_and_items_once(spark, tmp_path):
    schema = "experiment string, call long, image_id long, failed boolean, predicted_label string, input_tokens long, output_tokens long, ts timestamp"
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    files_of = [
        [("e", 1, 7, False, "HP", 10, 1, at(0)), ("e", 1, 7, False, "HP", 10, 1, at(0)), ("e", 2, 7, False, "SSA", 10, 1, at(1)), ("f", 3, 7, True, None, 5, 0, at(1))],
        [("e", 1, 7, False, "HP", 10, 1, at(0)), ("e", 4, 8, False, "HP", 10, 1, at(60))],
        [("e", 5, 9, False, "HP", 1000, 1, at(2)), ("e", 4, 8, False, "HP", 10, 1, at(60)), ("e", 6, 8, False, "HP", None, 1, at(61))],  # the first is late by then
    ]
    for i, rows in enumerate(files_of):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files go by their time
    read = spark.read.parquet(str(tmp_path / "in")).schema

    def last(name, **options):
        out = calls.running_cost(calls.table_stream(spark, str(tmp_path / "in"), read), "call", "image_id", **options)
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/{name}/{n}")
        out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()
        parts = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
        return {r["experiment"]: (r["calls"], r["answered"], r["cost"], r["over_budget"]) for r in calls.total_cost(parts, 1e6, 0.0, 50.0).collect()}

    assert last("all") == {"e": (5, 3, 1030.0, True), "f": (1, 0, 5.0, False)}
    assert last("timed", time="ts", delay="10 hours") == {"e": (4, 2, 30.0, False), "f": (1, 0, 5.0, False)}


def test_running_cost_takes_no_call_to_python(spark, tmp_path):
    """What a call costs is a look-up in Spark's own state; a call that comes again in a later batch doesn't count."""
    schema = "experiment string, call long, image_id long, failed boolean, predicted_label string, input_tokens long, output_tokens long"
    for rows in ([(e, i, i % 7, i % 5 == 0, "HP" if i % 3 else None, i, 1) for e in "ef" for i in range(300)], [("e", i, i % 7, False, "HP", i, 1) for i in range(200, 400)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    out = calls.running_cost(calls.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "call", "image_id")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")
    query = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len({op["operatorName"] for p in query.recentProgress for op in p["stateOperators"]} & {"dedupe", "stateStoreSave"}) == 2
    found = {r["experiment"]: (r["calls"], r["answered"], r["cost"]) for r in calls.total_cost(spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out"), 1e6, 0.0, 1.0).collect()}
    assert found == {"e": (400, 7, float(sum(range(400)))), "f": (300, 7, float(sum(range(300))))}
