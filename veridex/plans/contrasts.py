"""Queries on metrics, calibration and contrasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import sign_test, sign_test_sql
from ..operators import contrast as C
from ..operators import evidence as E
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import wording as WO
from .registry import Tables, query

BINS = "(SELECT count(*) FROM range(1, 10) AS e(i) WHERE i * 0.1::DOUBLE <= confidence)"
FIRST = "SELECT image_id, prompt_id, arg_min(label_pred, seq) AS label_pred, arg_min(confidence, seq) AS confidence FROM (SELECT * FROM responses WHERE label_pred IS NOT NULL) GROUP BY ALL"
JUDGED = "SELECT r.*, a.label, a.ssa_votes FROM responses r JOIN annotations a USING (image_id) WHERE label_pred IS NOT NULL"
RA = ("responses", "annotations")


def judged(t: Tables):
    return L.with_truth(t.responses, t.annotations).where("label_pred IS NOT NULL")


@query("c5_with_truth", "SELECT count(*) FILTER (label IS NULL) AS n_rows, count(DISTINCT CASE WHEN label IS NULL THEN image_id END) AS n_ids FROM responses LEFT JOIN (SELECT * FROM annotations WHERE partition = 'train') USING (image_id)", RA)
def _(t: Tables):
    return L.unmatched(L.with_truth(t.responses, t.annotations.where("partition = 'train'")))


@query("d7_classification", f"""
    SELECT prompt_id, CASE WHEN ssa_votes IN (0, 7) THEN 'unanimous' WHEN ssa_votes IN (3, 4) THEN 'borderline' ELSE 'strong' END AS agreement_band,
           count(*) AS n, count(*) FILTER (label = label_pred) AS k, count(*) FILTER (label = label_pred)::DOUBLE / count(*) AS accuracy,
           count(*) FILTER (label_pred = 'SSA') AS predicted_ssa, count(*) FILTER (label = 'SSA') AS true_ssa, avg(coalesce(confidence, 0)) AS mean_confidence
    FROM ({JUDGED}) GROUP BY ALL""", RA, ("accuracy", "mean_confidence"))
def _(t: Tables):
    return M.classification_summary(t.responses.join(L.agreement(t.annotations), "image_id"), ["prompt_id", "agreement_band"])


@query("d8_binary_metrics", f"""
    WITH c AS (SELECT prompt_id, count(*) FILTER (label = 'SSA' AND label_pred = 'SSA') AS tp, count(*) FILTER (label <> 'SSA' AND label_pred = 'SSA') AS fp,
                      count(*) FILTER (label = 'SSA' AND label_pred <> 'SSA') AS fn, count(*) FILTER (label <> 'SSA' AND label_pred <> 'SSA') AS tn FROM ({JUDGED}) GROUP BY 1)
    SELECT *, (tp + tn)::DOUBLE / greatest(tp + fp + fn + tn, 1) AS accuracy, tp::DOUBLE / greatest(tp + fp, 1) AS precision, tp::DOUBLE / greatest(tp + fn, 1) AS recall,
           2 * tp::DOUBLE / greatest(2 * tp + fp + fn, 1) AS f1 FROM c""", RA, ("accuracy", "precision", "recall", "f1"))
def _(t: Tables):
    return M.binary_metrics(judged(t), "label", "label_pred", ["prompt_id"])


_AUC = """
    WITH c AS (SELECT confidence AS s, count(*) FILTER (label = 'SSA') AS p, count(*) FILTER (label <> 'SSA') AS q FROM ({rows}) GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (below + q / 2.0::DOUBLE))::DOUBLE / (sum(p) * sum(q))::DOUBLE END AS auc, sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives FROM b"""


@query("d9_roc_auc", _AUC.format(rows=JUDGED), RA, ("auc",))
def _(t: Tables):
    return M.roc_auc(judged(t), "confidence", F.col("label") == "SSA")


@query("d9_roc_auc_prices", _AUC.format(rows="SELECT o_totalprice AS confidence, CASE WHEN o_orderpriority < '3' THEN 'SSA' ELSE 'HP' END AS label FROM orders"), (), ("auc",))
def _(t: Tables):
    rows = t.orders.select(F.col("o_totalprice").alias("confidence"), F.when(F.col("o_orderpriority") < "3", "SSA").otherwise("HP").alias("label"))
    return M.roc_auc(rows, "confidence", F.col("label") == "SSA")


@query("e3_midranks", f"""
    SELECT prompt_id, s, n, coalesce(sum(n) OVER (PARTITION BY prompt_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS midrank
    FROM (SELECT prompt_id, confidence AS s, count(*) AS n FROM ({JUDGED}) GROUP BY ALL)""", RA, ("midrank",))
def _(t: Tables):
    return M.midranks(judged(t), "confidence", ["prompt_id"])


@query("d10_log_loss", f"SELECT prompt_id, avg(-ln(greatest(CASE WHEN label = label_pred THEN confidence ELSE 1 - confidence END, 1e-15))) AS log_loss, count(*) AS n FROM ({JUDGED}) GROUP BY 1", RA, ("log_loss",))
def _(t: Tables):
    p = F.when(F.col("label") == F.col("label_pred"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    return M.log_loss(judged(t), p, ["prompt_id"])


_ECE = f"""SELECT prompt_id, sum(abs(r - c)) / sum(n) AS ece, sum(n)::BIGINT AS n FROM (
    SELECT prompt_id, {BINS} AS bin, count(*) AS n, sum(confidence) AS c, count(*) FILTER (label = label_pred)::DOUBLE AS r FROM ({{rows}}) GROUP BY ALL) GROUP BY 1"""


@query("d11_ece", _ECE.format(rows=JUDGED), RA, ("ece",))
def _(t: Tables):
    return M.ece(judged(t), by=["prompt_id"])


@query("d12_reliability", f"""
    WITH f AS (SELECT prompt_id, {BINS} AS bin, count(*) AS n, avg(confidence) AS avg_confidence, avg((label = label_pred)::INT::DOUBLE) AS accuracy FROM ({JUDGED}) GROUP BY ALL)
    SELECT prompt_id, bin, bin * 0.1::DOUBLE AS low, (bin + 1) * 0.1::DOUBLE AS high, coalesce(n, 0) AS n, avg_confidence, accuracy
    FROM (SELECT DISTINCT prompt_id FROM responses) CROSS JOIN range(10) AS b(bin) LEFT JOIN f USING (prompt_id, bin)""", RA, ("low", "high", "avg_confidence", "accuracy"))
def _(t: Tables):
    return M.reliability_curve(judged(t), by=["prompt_id"])


@query("d13_confidence_audit", f"""
    WITH j AS (SELECT f.*, a.label FROM (SELECT image_id, prompt_id, arg_min(coalesce(label_pred, '?'), seq) AS label_pred, arg_min(confidence, seq) AS confidence FROM responses GROUP BY ALL) f
               JOIN annotations a USING (image_id) WHERE label_pred <> '?'), e AS ({_ECE.format(rows="FROM j")})
    SELECT prompt_id, n, CASE WHEN n >= 30 THEN ece END AS ece, n >= 30 AS usable, n >= 30 AND ece <= 0.1 AS calibrated FROM e""".replace("FROM (FROM j)", "FROM j"), RA, ("ece",))
def _(t: Tables):
    return M.confidence_audit(t.responses, t.annotations, by=["prompt_id"])


@query("d17_sign_test", f"SELECT custs, pos, neg, {sign_test_sql('pos', 'neg')} AS p_value FROM (SELECT o_orderpriority AS custs, count(*) FILTER (o_orderkey % 2 = 0) // 50 AS pos, count(*) FILTER (o_orderkey % 2 = 1) // 60 AS neg FROM orders GROUP BY 1)", (), ("p_value",))
def _(t: Tables):
    c = t.orders.groupBy(F.col("o_orderpriority").alias("custs")).agg(F.expr("count_if(o_orderkey % 2 = 0) DIV 50").alias("pos"), F.expr("count_if(o_orderkey % 2 = 1) DIV 60").alias("neg"))
    return c.withColumn("p_value", sign_test("pos", "neg"))


_MASKED = """(SELECT r.image_id, r.prompt_id, r.replicate, r.seq, r.label_pred, r.confidence, b.label_pred AS base_label, b.confidence AS base_confidence
    FROM responses r LEFT JOIN (SELECT image_id, arg_max(label_pred, seq) AS label_pred, arg_max(confidence, seq) AS confidence
        FROM (SELECT * FROM responses WHERE prompt_id = 'co_p1' AND replicate = 1 AND label_pred IS NOT NULL) GROUP BY 1) b USING (image_id) WHERE r.prompt_id <> 'co_p1')"""


def masked(t: Tables):
    return C.with_baseline(t.responses.where("prompt_id <> 'co_p1'"), t.responses.where("prompt_id = 'co_p1'"))


@query("c2_with_baseline", f"SELECT prompt_id, count(*) AS n, count(base_label) AS n_based, avg(base_confidence) AS mean_base FROM {_MASKED} GROUP BY 1", ("responses",), ("mean_base",))
def _(t: Tables):
    return masked(t).groupBy("prompt_id").agg(F.count("*").alias("n"), F.count("base_label").alias("n_based"), F.avg("base_confidence").alias("mean_base"))


_FLIP = "CASE WHEN label_pred IS NULL OR base_label IS NULL THEN NULL WHEN label_pred <> base_label THEN 1 ELSE 0 END"
_ARMS = f"""(SELECT image_id, replicate, arg_max(f, seq) FILTER (prompt_id = 'cte_p1') AS treat, arg_max(f, seq) FILTER (prompt_id = 'etc_p1') AS ctrl
    FROM (SELECT *, {_FLIP} AS f FROM {_MASKED}) WHERE f IS NOT NULL GROUP BY ALL HAVING treat IS NOT NULL AND ctrl IS NOT NULL)"""


def arms(t: Tables):
    return C.pair_arms(masked(t).withColumn("flipped", C.flipped(t)), ["image_id", "replicate"], "prompt_id", "cte_p1", "etc_p1")


@query("c3_pair_arms", f"SELECT image_id, replicate, treat, ctrl FROM {_ARMS}", ("responses",))
def _(t: Tables):
    return arms(t)


@query("c4_pair_conditions", f"""
    WITH f AS ({FIRST}) SELECT count(*) AS items, count(*) FILTER (a.label_pred = b.label_pred) AS agreeing
    FROM f a JOIN f b USING (image_id) WHERE a.prompt_id = 'cte_p1' AND b.prompt_id = 'etc_p1'""", ("responses",))
def _(t: Tables):
    f = L.dedup(t.responses.where("label_pred IS NOT NULL"), ["image_id", "prompt_id"])
    both = C.pair_conditions(f.where("prompt_id = 'cte_p1'"), f.where("prompt_id = 'etc_p1'"))
    return both.agg(F.count("*").alias("items"), F.count_if(F.col("label_pred_a") == F.col("label_pred_b")).alias("agreeing"))


@query("c11_common_items", "SELECT image_id FROM responses WHERE label_pred IS NOT NULL GROUP BY 1 HAVING count(DISTINCT prompt_id) = 3", ("responses",))
def _(t: Tables):
    return C.common_items(t.responses.where("label_pred IS NOT NULL"), "image_id", "prompt_id", 3)


_SUMMARY = "count(*) AS n, count(*) FILTER (label_pred <> base_label) AS flips, count(*) FILTER (label_pred <> base_label)::DOUBLE / greatest(count(*), 1) AS flip_rate, avg(abs(coalesce(confidence, 0) - coalesce(base_confidence, 0))) AS mean_abs_dconf, count(DISTINCT CASE WHEN label_pred <> base_label THEN image_id END) AS flipped_items"


@query("d14_arm_summary", f"SELECT prompt_id, replicate, {_SUMMARY} FROM {_MASKED} WHERE label_pred IS NOT NULL AND base_label IS NOT NULL GROUP BY ALL", ("responses",), ("flip_rate", "mean_abs_dconf"))
def _(t: Tables):
    return C.arm_summary(masked(t), ["prompt_id", "replicate"])


_DISC = "count(*) FILTER (treat = 1 AND ctrl <> 1) AS treat_only, count(*) FILTER (treat <> 1 AND ctrl = 1) AS ctrl_only"


@query("d15_discordance", f"""
    SELECT *, {sign_test_sql('treat_only', 'ctrl_only')} AS p_value FROM (
        SELECT replicate, count(*) AS pairs, {_DISC}, count(*) FILTER (treat = 1 AND ctrl = 1) AS both, count(*) FILTER (treat <> 1 AND ctrl <> 1) AS neither FROM {_ARMS} GROUP BY 1)""", ("responses",), ("p_value",))
def _(t: Tables):
    return C.discordance(arms(t), ["replicate"])


@query("d16_pooled_discordance", f"SELECT *, {sign_test_sql('treat_only', 'ctrl_only')} AS p_value FROM (SELECT replicate, count(*) AS pairs, {_DISC} FROM {_ARMS} GROUP BY ROLLUP (replicate))", ("responses",), ("p_value",))
def _(t: Tables):
    return C.pooled_discordance(arms(t), "replicate")


_STRUCT = f"(SELECT *, CASE replicate % 3 WHEN 0 THEN 'nuclei' WHEN 1 THEN 'epithelium' ELSE 'stroma' END AS source, CASE prompt_id WHEN 'cte_p1' THEN 'treatment' ELSE 'control' END AS arm, (image_id % 100)::DOUBLE AS struct_tissue_pct, (image_id % 90)::DOUBLE AS control_tissue_pct, image_id % 2 = 0 AS named FROM {_MASKED})"


def structures(t: Tables):
    r = F.col("replicate") % 3
    return masked(t).withColumns({
        "source": F.when(r == 0, "nuclei").when(r == 1, "epithelium").otherwise("stroma"), "arm": F.when(F.col("prompt_id") == "cte_p1", "treatment").otherwise("control"),
        "struct_tissue_pct": (F.col("image_id") % 100).cast("double"), "control_tissue_pct": (F.col("image_id") % 90).cast("double"), "named": F.col("image_id") % 2 == 0,
    })


@query("d19_structure_summary", f"SELECT source, arm, {_SUMMARY}, avg(CASE arm WHEN 'treatment' THEN struct_tissue_pct ELSE control_tissue_pct END) AS mean_masked_pct FROM {_STRUCT} WHERE label_pred IS NOT NULL AND base_label IS NOT NULL GROUP BY ALL", ("responses",), ("flip_rate", "mean_abs_dconf", "mean_masked_pct"))
def _(t: Tables):
    return C.structure_summary(structures(t))


@query("d20_named_split", f"SELECT source, named, count(*) AS n, count(*) FILTER (label_pred <> base_label) AS flips, count(*) FILTER (label_pred <> base_label)::DOUBLE / count(*) AS flip_rate FROM {_STRUCT} WHERE arm = 'treatment' AND label_pred IS NOT NULL AND base_label IS NOT NULL GROUP BY ALL", ("responses",), ("flip_rate",))
def _(t: Tables):
    return C.named_split(structures(t))


@query("d21_paraphrase_summary", f"""
    WITH d AS (SELECT c || '_p' || i AS prompt_id FROM (VALUES ('co'), ('cte'), ('etc')) AS x(c), range(1, 4) AS y(i)),
    f AS (SELECT prompt_id, count(*) AS n, count(*) FILTER (label_pred = label) AS correct, count(*) FILTER (label_pred = 'SSA') AS positives, avg(coalesce(confidence, 0)) AS mean_confidence FROM ({JUDGED}) GROUP BY 1)
    SELECT prompt_id, coalesce(n, 0) AS n, coalesce(correct, 0) AS correct, coalesce(positives, 0) AS positives, mean_confidence, n IS NULL AS missing FROM d LEFT JOIN f USING (prompt_id)""", RA, ("mean_confidence",))
def _(t: Tables):
    design = t.spark.createDataFrame([(f"{c}_p{i}",) for c in ("co", "cte", "etc") for i in (1, 2, 3)], "prompt_id string")
    return C.paraphrase_summary(judged(t), design)


@query("d22_directional_flips", f"""
    WITH b AS (SELECT image_id, replicate % 3 AS wording, arg_max(label_pred, seq) FILTER (prompt_id = 'cte_p1') AS a, arg_max(label_pred, seq) FILTER (prompt_id = 'etc_p1') AS b
               FROM (SELECT * FROM responses WHERE label_pred IS NOT NULL) GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)
    SELECT *, {sign_test_sql('hp_to_ssa', 'ssa_to_hp')} AS p_value FROM (SELECT wording, count(*) AS items, count(*) FILTER (a = 'HP' AND b = 'SSA') AS hp_to_ssa, count(*) FILTER (a = 'SSA' AND b = 'HP') AS ssa_to_hp FROM b GROUP BY 1)""", ("responses",), ("p_value",))
def _(t: Tables):
    runs = t.responses.withColumns({"wording": F.col("replicate") % 3, "condition": F.col("prompt_id")})
    return C.directional_flips(runs, "cte_p1", "etc_p1", ["wording"])


@query("d23_wording_unanimity", "SELECT count(*) AS shared_items, count(*) FILTER (l = 1) AS unanimous FROM (SELECT image_id, count(DISTINCT label_pred) AS l FROM responses WHERE label_pred IS NOT NULL GROUP BY 1 HAVING count(DISTINCT prompt_id) = 3)", ("responses",))
def _(t: Tables):
    return C.wording_unanimity(t.responses, 3)


_STOP = ", ".join(f"'{w}'" for w in WO.STOP_WORDS)
_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))))"


@query("d24_condition_similarity", f"""
    WITH m AS (SELECT c.image_id, c.prompt_id, bit_or(CAST(1 AS BIGINT) << cell_idx) AS mask, list_distinct(list(DISTINCT c.feature || cell_idx % 2)) AS f FROM citations c GROUP BY ALL),
    l AS ({FIRST}), s AS (SELECT m.*, l.label_pred FROM m LEFT JOIN l USING (image_id, prompt_id)),
    ps AS (SELECT a.mask AS am, b.mask AS bm, a.f AS af, b.f AS bf, a.label_pred AS al, b.label_pred AS bl FROM s a JOIN s b USING (image_id) WHERE a.prompt_id = 'cte_p1' AND b.prompt_id = 'etc_p1')
    SELECT count(*) AS items, avg(bit_count(am & bm)::DOUBLE / bit_count(am | bm)) AS cell_jaccard, avg(len(list_intersect(af, bf))::DOUBLE / len(list_distinct(list_concat(af, bf)))) AS feature_jaccard,
           avg(len(list_intersect(af, bf))::DOUBLE / len(list_distinct(list_concat(af, bf)))) AS token_jaccard, count(*) FILTER (al = bl)::DOUBLE / greatest(count(*) FILTER (al IS NOT NULL AND bl IS NOT NULL), 1) AS label_agreement FROM ps""",
    ("citations", "responses"), ("cell_jaccard", "feature_jaccard", "token_jaccard", "label_agreement"))
def _(t: Tables):
    m = E.cited_cells(t.citations, ["image_id", "prompt_id"]).drop("cells")
    f = t.citations.groupBy("image_id", "prompt_id").agg(F.collect_set(F.concat("feature", (F.col("cell_idx") % 2).cast("string"))).alias("features"))
    lab = L.dedup(t.responses.where("label_pred IS NOT NULL"), ["image_id", "prompt_id"]).select("image_id", "prompt_id", F.col("label_pred").alias("label"))
    s = m.join(f, ["image_id", "prompt_id"]).join(lab, ["image_id", "prompt_id"], "left").withColumn("tokens", F.col("features"))
    return C.condition_similarity(C.pair_conditions(s.where("prompt_id = 'cte_p1'"), s.where("prompt_id = 'etc_p1'")))


@query("d25_similarity_position", """
    WITH m AS (SELECT image_id, prompt_id, replicate, bit_or(CAST(1 AS BIGINT) << cell_idx) AS mask FROM citations GROUP BY ALL),
    c AS (SELECT mask, count(*) AS n FROM m WHERE prompt_id = 'cte_p1' GROUP BY 1),
    fl AS (SELECT sum(w * j) / sum(w) AS floor FROM (SELECT CASE WHEN a.mask = b.mask THEN a.n * (a.n - 1) / 2.0::DOUBLE ELSE a.n * b.n::DOUBLE END AS w, bit_count(a.mask & b.mask)::DOUBLE / bit_count(a.mask | b.mask) AS j FROM c a JOIN c b ON a.mask <= b.mask)),
    ce AS (SELECT avg(bit_count(a.mask & b.mask)::DOUBLE / bit_count(a.mask | b.mask)) AS ceiling FROM m a JOIN m b ON a.image_id = b.image_id AND a.prompt_id = 'cte_p1' AND b.prompt_id = 'cte_p1' AND a.replicate < b.replicate),
    cr AS (SELECT avg(bit_count(a.mask & b.mask)::DOUBLE / bit_count(a.mask | b.mask)) AS cross FROM m a JOIN m b ON a.image_id = b.image_id AND a.replicate = b.replicate AND a.prompt_id = 'cte_p1' AND b.prompt_id = 'etc_p1')
    SELECT floor, ceiling, "cross", CASE WHEN ceiling > floor THEN ("cross" - floor) / (ceiling - floor) END AS position FROM fl, ce, cr""".replace("AS cross FROM", 'AS "cross" FROM'),
    ("citations",), ("floor", "ceiling", '"cross"', "position"))
def _(t: Tables):
    m = E.cited_cells(t.citations).drop("cells")
    cte, etc = m.where("prompt_id = 'cte_p1'"), m.where("prompt_id = 'etc_p1'")
    floor = E.between_item_similarity(cte).select(F.col("mean_jaccard").alias("floor"))
    ceiling = E.replicate_pairs(cte, ["image_id"]).agg(F.avg("jaccard").alias("ceiling"))
    both = cte.select("image_id", "replicate", F.col("mask").alias("x")).join(etc.select("image_id", "replicate", F.col("mask").alias("y")), ["image_id", "replicate"])
    from ..functions.columns import jaccard_masks

    return C.similarity_position(floor, ceiling, both.agg(F.avg(jaccard_masks("x", "y")).alias("cross")))


@query("d27_feature_usage", "SELECT prompt_id, feature, count(*) AS n FROM citations WHERE replicate = 1 GROUP BY ALL", ("citations",))
def _(t: Tables):
    return C.feature_usage(t.citations.where("replicate = 1"), ["prompt_id"])


_PAIRED = "(SELECT l_orderkey % 2 AS truth, l_quantity / 50::DOUBLE AS p_clean, l_discount * 10::DOUBLE AS p_changed, l_linenumber = 7 AS failed FROM lineitem)"


@query("d33_paired_robustness", f"""
    SELECT *, accuracy_changed - accuracy_clean AS accuracy_delta, auc_changed - auc_clean AS auc_delta FROM (
    SELECT count(*) AS n, count(*) FILTER ((p_clean >= 0.5) = (truth = 1))::DOUBLE / count(*) AS accuracy_clean, count(*) FILTER ((p_changed >= 0.5) = (truth = 1))::DOUBLE / count(*) AS accuracy_changed,
           count(*) FILTER ((p_clean >= 0.5) <> (p_changed >= 0.5))::DOUBLE / count(*) AS flip_rate, avg(abs(p_clean - p_changed)) AS mean_abs_change, count(*) FILTER (failed)::DOUBLE / count(*) AS failure_rate,
           (SELECT auc FROM ({_AUC.format(rows=f"SELECT p_clean AS confidence, CASE WHEN truth = 1 THEN 'SSA' ELSE 'HP' END AS label FROM {_PAIRED}")})) AS auc_clean,
           (SELECT auc FROM ({_AUC.format(rows=f"SELECT p_changed AS confidence, CASE WHEN truth = 1 THEN 'SSA' ELSE 'HP' END AS label FROM {_PAIRED}")})) AS auc_changed
    FROM {_PAIRED})""", (), ("accuracy_clean", "accuracy_changed", "flip_rate", "mean_abs_change", "failure_rate", "auc_clean", "auc_changed", "accuracy_delta", "auc_delta"))
def _(t: Tables):
    rows = t.lineitem.select((F.col("l_orderkey") % 2).alias("truth"), (F.col("l_quantity") / F.lit(50.0)).alias("p_clean"), (F.col("l_discount") * F.lit(10.0)).alias("p_changed"), (F.col("l_linenumber") == 7).alias("failed"))
    return M.paired_robustness(rows)


@query("d34_faithfulness", """
    SELECT l_returnflag AS mask_type, count(*) AS n, avg(a - b) AS comprehensiveness, avg(a - d) AS sufficiency, avg((a - b) - (a - c)) AS net_drop, count(*) FILTER ((a > 0.5) <> (b > 0.5))::DOUBLE / count(*) AS flip_rate
    FROM (SELECT *, l_quantity / 50::DOUBLE AS a, l_discount * 10::DOUBLE AS b, l_tax * 12::DOUBLE AS c, l_linenumber / 7::DOUBLE AS d FROM lineitem) GROUP BY 1""", (), ("comprehensiveness", "sufficiency", "net_drop", "flip_rate"))
def _(t: Tables):
    a, b = F.col("l_quantity") / F.lit(50.0), F.col("l_discount") * F.lit(10.0)
    rows = t.lineitem.select(F.col("l_returnflag").alias("mask_type"), a.alias("orig_conf"), b.alias("new_conf"), (F.col("l_tax") * F.lit(12.0)).alias("control_conf"), (F.col("l_linenumber") / F.lit(7.0)).alias("sufficiency_conf"), (a > 0.5).alias("orig_label"), (b > 0.5).alias("new_label"))
    return C.faithfulness(rows, ["mask_type"])


@query("d36_centrality_corr", """
    WITH cited AS (SELECT DISTINCT image_id, prompt_id, replicate, cell_idx FROM citations), n AS (SELECT cell_idx, count(*) AS c FROM cited GROUP BY 1),
    a AS (SELECT cell_idx, cell, count(*) FILTER (tissue_pct >= 5) AS av FROM coverage GROUP BY ALL)
    SELECT corr(coalesce(c, 0), CASE WHEN cell IN ('B2', 'B3', 'C2', 'C3') THEN 1.0 ELSE 0.0 END) AS with_centrality, corr(coalesce(c, 0), av) AS with_availability FROM a LEFT JOIN n USING (cell_idx)""",
    ("citations", "coverage"), ("with_centrality", "with_availability"))
def _(t: Tables):
    return C.centrality_corr(E.cell_frequency(t.citations, t.coverage))


_TAIL = "list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)) FOR j IN range({}, {})])"


@query("d37_binomial_ci", f"""
    WITH RECURSIVE c AS (SELECT prompt_id, count(*) FILTER (label = label_pred) AS k, count(*) AS n FROM responses JOIN annotations USING (image_id) WHERE label_pred IS NOT NULL GROUP BY 1),
    b AS (SELECT prompt_id, k, n, side, 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.5::DOUBLE AS p FROM c, (VALUES (0), (1)) AS s(side)
          UNION ALL SELECT prompt_id, k, n, side, i + 1, low, high, (low + high) / 2 FROM (
              SELECT prompt_id, k, n, side, i, CASE WHEN up THEN p ELSE low END AS low, CASE WHEN up THEN high ELSE p END AS high FROM (
                  SELECT *, CASE WHEN side = 0 THEN {_TAIL.format('k', 'n + 1')} < 0.025 ELSE {_TAIL.format('0', 'k + 1')} > 0.025 END AS up FROM b WHERE i < 40)))
    SELECT prompt_id, k, n, round(max(p) FILTER (side = 0), 6) AS ci_low, round(max(p) FILTER (side = 1), 6) AS ci_high FROM b WHERE i = 40 GROUP BY ALL""", RA)
def _(t: Tables):
    counts = M.classification_summary(t.responses.join(t.annotations, "image_id"), ["prompt_id"]).select("prompt_id", "k", "n")
    return M.binomial_ci(t.spark, counts, "k", "n").withColumns({c: F.round(c, 6) for c in ("ci_low", "ci_high")})
