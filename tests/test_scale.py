"""What larger tables would break: sides sent through the driver, one key in one task, memory that grows with the input."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veridex.operators import answers, evidence, metrics, tiles
from veridex.plans import fixtures

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_tile_meet_without_a_join(spark):
    assert "Join" not in plan(entry.queries()["h11_block_shuffle"](spark, SF))


def test_runs_are_not_sorted_to_meet_their_truth(spark):
    from veridex.operators import ledger

    runs, truth = spark.range(50).withColumnRenamed("id", "image_id"), spark.range(40).select(F.col("id").alias("image_id"), F.lit("HP").alias("label"))
    joined = ledger.with_truth(runs, truth)
    assert "SortMergeJoin" not in plan(joined) and "Broadcast" not in plan(joined) and joined.where("label IS NULL").count() == 10
    assert "Join" not in plan(entry.queries()["d8_binary_metrics"](spark, SF))  # counted once, not for its labels and again for its counts


def test_tables_of_tiles_are_not_broadcast(spark):
    for name in ("i9_box_accounting", "i9_mask_accounting", "i5_mask_mean", "i8_region_mask"):
        assert "Broadcast" not in plan(entry.queries()[name](spark, SF)), name


def test_a_set_of_all_cells_is_a_row_without_control_on_both_sides(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/orders.parquet' WHERE o_orderkey < 12) TO '{tmp_path}/orders.parquet'")
    # lines of order 0 cite each cell
    con.execute(f"""COPY (SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey BETWEEN 1 AND 11 UNION ALL
        SELECT l.* REPLACE (0 AS l_orderkey, i AS l_partkey, 0 AS l_suppkey, 1 AS l_linenumber, 'N' AS l_returnflag) FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1) l, range(16) AS c(i)) TO '{tmp_path}/lineitem.parquet'""")
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    columns = "image_id, mask, control_mask, overlap, tissue_gap"
    wanted = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()['c12_matched_control']}) ORDER BY 1").fetchall()
    found = sorted(tuple(r) for r in entry.queries()["c12_matched_control"](spark, str(tmp_path)).select(*columns.split(", ")).collect())
    assert found == wanted and found[0] == (0, 65535, None, None, None)


def test_citations_are_not_dealt_out_by_their_few_features(spark):
    for name in ("b23_feature_source", "b19_rubric_relevance"):
        assert "SortMergeJoin" not in plan(entry.queries()[name](spark, SF)), name


def test_counts_of_classes_need_no_annotations(spark):
    assert "SortMergeJoin" not in (found := plan(entry.queries()["d29_class_counts"](spark, SF))) and "BroadcastHashJoin" not in found


def test_tiles_of_a_batch_are_worked_on_in_small_stacks():
    ids = np.arange(10_000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(np.full(len(ids), 8, dtype=np.int32))] * 2, tiles._binary(fixtures.drawn(ids))], names=["image_id", "height", "width", "rgb"])
    tracemalloc.start()
    seen = sum(len(tiles.macenko(rgb)) for rgb, _ in tiles.stacks(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(ids) and peak < 40e6


def test_answers_are_parsed_once(spark):
    raw = spark.createDataFrame([('{"label": "HP", "confidence": 0.5, "evidence": []}',), ("{",), (None,)], "raw string")
    out = answers.validate(raw, "raw", answers.Protocol(), strict=True)
    assert plan(out).count("parseJson") == 1
    good, bad = answers.split_valid(out)
    assert "parseJson" not in plan(good) + plan(bad) and (good.count(), bad.count()) == (1, 2)


def test_keys_are_checked_without_writing_parts_of_an_answer_again(spark):
    item = '{"feature": "stroma", "grid_cells": ["A1"], "description": "x"%s}'
    answer = '{"label": "HP", "confidence": 0.5, "evidence": [%s]}'
    items = [item % "", item % ', "more": null', '{"feature": "stroma", "grid_cells": ["A1"]}', "7", "null", f"{item % ''}, [{item % ''}]"]
    raw = spark.createDataFrame([(answer % i,) for i in items], "raw string")
    out = answers.validate(raw, "raw", answers.Protocol(), strict=True)
    assert ["item keys" in r["violations"] for r in out.collect()] == [False] + [True] * 5
    assert "StructsToJson" not in plan(out) and "jsonObjectKeys" not in plan(out) and plan(out).count("schemaOfVariant") <= 2


def test_equal_answers_are_validated_once(spark, tmp_path, monkeypatch):
    con, given = duckdb.connect(), []
    # a third of the responses has no label; labels of the others go by whether the order's number is odd
    con.execute("""CREATE TABLE lineitem AS SELECT i AS l_orderkey, CASE WHEN i % 3 = 0 THEN 11 ELSE 16 END AS l_partkey, 0 AS l_suppkey, 1 AS l_linenumber,
        25.0::DOUBLE AS l_quantity, CASE WHEN i % 3 = 2 THEN 'A' ELSE 'N' END AS l_returnflag FROM range(300) AS x(i)""")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    split = answers.split_valid
    monkeypatch.setattr(answers, "split_valid", lambda df: given.append(df) or split(df))
    found = sorted(map(tuple, entry.queries()["b4_validate_strict"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(entry.oracle_sql()["b4_validate_strict"]).fetchall()) == [("co_p1", 100, 0), ("cte_p1", 100, 100)]
    assert given[0].count() == 5


def test_citations_are_shuffled_once_to_be_nested(spark):
    rows = spark.createDataFrame([(1, "p", 1, 0, "stroma", c) for c in (5, 0, 5)] + [(1, "p", 1, 1, "serration", 15)], "image_id long, prompt_id string, replicate int, item int, feature string, cell_idx int")
    out = evidence.nested(rows)
    assert out.select("evidence").first()[0] == [(0, "stroma", ["A1", "B2", "B2"], "seen in stroma"), (1, "serration", ["D4"], "seen in serration")]
    assert plan(out).count("Exchange") == 1


def test_a_draw_of_the_bootstrap_is_made_once(spark):
    rows = spark.createDataFrame([(str(i), float(i % 7), i % 3 == 0) for i in range(50)], "row_key string, s double, t boolean")
    logical = metrics.bootstrap_auc(rows, "s", F.col("t"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < logical.count("md5(") <= 2  # the AUC reads its counts twice


def plain_json(raw: str) -> tuple:
    start = raw.find("{")
    if start < 0:
        return None, "no opening brace"
    depth, quoted, escaped = 0, False, False
    for i, c in enumerate(raw[start:]):
        if quoted:
            quoted, escaped = c != '"' or escaped, c == "\\" and not escaped
        elif c == '"':
            quoted = True
        else:
            depth += {"{": 1, "}": -1}.get(c, 0)
            if c == "}" and depth == 0:
                return raw[start : start + i + 1], None
    return None, "unbalanced braces"


def test_braces_by_runs_of_characters_equal_those_by_character(spark):
    rng = np.random.default_rng(3)
    marks = list('{}{}""\\a\n') + ["\U0001f600"]
    raws = ["".join(rng.choice(marks, rng.integers(0, 25))) for _ in range(3000)] + ["{" + '\\\\"x' * 50_000 + "}"]
    out = spark.createDataFrame([(r,) for r in raws], "raw string").select("raw", answers.extract_json("raw").alias("x"))
    assert [(r["raw"], tuple(r["x"])) for r in out.collect()] == [(r, plain_json(r)) for r in raws]
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
