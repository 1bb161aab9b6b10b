"""Queries on resampling, controls and nulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import u_sql
from ..operators import evidence as E
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import nulls as N
from ..operators import resample as S
from .contrasts import JUDGED, RA, judged
from .registry import Tables, query

SEED = 1789
IMAGE_MASKS = "SELECT image_id, CAST(bit_or(CAST(1 AS BIGINT) << cell_idx) AS BIGINT) AS mask FROM citations WHERE prompt_id = 'cte_p1' GROUP BY 1"
EMPTIES = "SELECT image_id, CAST(coalesce(bit_or(CASE WHEN tissue_pct < 5 THEN CAST(1 AS BIGINT) << cell_idx END), 0) AS BIGINT) AS empty_mask FROM coverage GROUP BY 1"
CC = ("citations", "coverage")
_POISSON = " + ".join(f"({{u}} >= {x})::INT" for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183))


def image_masks(t: Tables):
    return E.cited_cells(t.citations.where("prompt_id = 'cte_p1'"), ["image_id"]).drop("cells")


@query("h1_bootstrap_auc", f"""
    WITH r AS (SELECT *, image_id || '|' || replicate || '|' || prompt_id || '|' || seq AS row_key FROM ({JUDGED})),
    d AS (SELECT b, confidence AS s, label, {_POISSON.format(u=u_sql(42, 'b', 'row_key'))} AS w FROM r, range(1000) AS x(b)),
    c AS (SELECT b, s, sum(CASE WHEN label = 'SSA' THEN w ELSE 0 END) AS p, sum(CASE WHEN label = 'SSA' THEN 0 ELSE w END) AS q FROM d WHERE w > 0 GROUP BY ALL),
    z AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
    a AS (SELECT b, CASE WHEN sum(p) * sum(q) > 0 THEN sum(p * (below + q / 2.0::DOUBLE))::DOUBLE / (sum(p) * sum(q))::DOUBLE END AS auc FROM z GROUP BY 1)
    SELECT quantile_cont(auc, 0.025) AS ci_low, quantile_cont(auc, 0.975) AS ci_high, count(auc) AS replicates FROM a""", RA, ("ci_low", "ci_high"))
def _(t: Tables):
    rows = judged(t).withColumn("row_key", F.concat_ws("|", *[F.col(c).cast("string") for c in ("image_id", "replicate", "prompt_id", "seq")]))
    return M.bootstrap_auc(rows, "confidence", F.col("label") == "SSA", 1000)


@query("h1_bootstrap_ci")
def _(t: Tables):
    """Three metrics at 1000 replicates; a cell of equal rows is drawn as one."""
    rows = judged(t).select("confidence", "label", "label_pred")
    right = F.sum(F.when(F.col("label") == F.col("label_pred"), F.col("w")).otherwise(0)) / F.sum("w")
    hit = F.sum(F.when((F.col("label") == "SSA") & (F.col("label_pred") == "SSA"), F.col("w")).otherwise(0))
    named = F.sum(F.when(F.col("label_pred") == "SSA", F.col("w")).otherwise(0))
    metrics = {
        "auc": lambda d: M.roc_auc(d, "confidence", F.col("label") == "SSA", ["b"], F.col("w")).select("b", F.col("auc").alias("value")),
        "accuracy": lambda d: d.groupBy("b").agg(right.alias("value")), "precision": lambda d: d.groupBy("b").agg(F.try_divide(hit, named).alias("value")),
    }
    return M.bootstrap_ci(rows, metrics, rows.columns)


@query("h2_uniform_sets")
def _(t: Tables):
    return N.uniform_sets(image_masks(t), 2000, SEED)


@query("h3_uniform_cells")
def _(t: Tables):
    return N.uniform_cells(image_masks(t).join(S.empties(t.coverage), "image_id"), 5000, SEED)


@query("h4_shuffled_items")
def _(t: Tables):
    return N.shuffled_items(image_masks(t).join(S.empties(t.coverage), "image_id"), 5000, SEED)


@query("h5_permuted_labels")
def _(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), (F.col("o_orderpriority") == "1-URGENT").alias("g"))
    return N.permuted_labels(rows, "x", "g", 20_000, SEED)


_DRAW = f"""(SELECT r, image_id, any_value(mask) AS mask, bit_or(CAST(1 AS BIGINT) << c::INT) AS drawn FROM (
    SELECT r, image_id, mask, c, row_number() OVER (PARTITION BY r, image_id ORDER BY {u_sql(SEED, 'r', 'image_id', 'c')}, c) AS k FROM m, range(2) AS x(r), range(16) AS y(c)) WHERE k <= bit_count(mask) GROUP BY ALL)"""
_SIM = "bit_count(a.mask & b.mask)::DOUBLE / bit_count(a.mask | b.mask)"


@query("h2_uniform_set_null", f"""
    WITH m AS ({IMAGE_MASKS}), o AS (SELECT mask, count(*) AS n FROM m GROUP BY 1),
    w AS (SELECT CASE WHEN a.mask = b.mask THEN a.n * (a.n - 1) / 2.0::DOUBLE ELSE a.n * b.n::DOUBLE END AS w, {_SIM} AS j FROM o a JOIN o b ON a.mask <= b.mask),
    ob AS (SELECT sum(w * j) / sum(w) AS observed FROM w), d AS (SELECT r, drawn AS mask, count(*) AS n FROM {_DRAW} GROUP BY ALL),
    v AS (SELECT a.r, CASE WHEN a.mask = b.mask THEN a.n * (a.n - 1) / 2.0::DOUBLE ELSE a.n * b.n::DOUBLE END AS w, {_SIM} AS j FROM d a JOIN d b ON a.r = b.r AND a.mask <= b.mask),
    z AS (SELECT r, sum(w * j) / sum(w) AS j FROM v GROUP BY 1)
    SELECT avg(j) AS null_mean, max(observed) AS observed, count(*) FILTER (j >= observed - 1e-12)::DOUBLE / count(*) AS p_value FROM z, ob""", ("citations",), ("null_mean", "observed", "p_value"))
def _(t: Tables):
    m = image_masks(t)
    return S.uniform_set_null(m, E.between_item_similarity(m), 2, SEED, ["image_id"])


@query("h3_uniform_cell_null", f"""
    WITH m AS ({IMAGE_MASKS}), e AS ({EMPTIES}),
    z AS (SELECT r, sum(bit_count(drawn & empty_mask)) AS hit, sum(bit_count(mask & empty_mask)) AS cited FROM {_DRAW} JOIN e USING (image_id) GROUP BY 1)
    SELECT max(cited)::BIGINT AS observed, avg(hit) AS null_mean, count(*) FILTER (hit <= cited)::DOUBLE / count(*) AS p_value FROM z""", CC, ("null_mean", "p_value"))
def _(t: Tables):
    return S.uniform_cell_null(image_masks(t), t.coverage, 2, SEED, ["image_id"])


@query("h3_uniform_cell_expectation", f"SELECT sum(bit_count(mask) * bit_count(empty_mask) / 16.0::DOUBLE) AS null_mean FROM ({IMAGE_MASKS}) JOIN ({EMPTIES}) USING (image_id)", CC, ("null_mean",))
def _(t: Tables):
    return S.uniform_cell_expectation(image_masks(t), t.coverage)


@query("h4_shuffled_item_null", f"""
    WITH m AS (SELECT * FROM ({IMAGE_MASKS}) JOIN ({EMPTIES}) USING (image_id)), i AS (SELECT r, m.* FROM m, range(3) AS x(r)),
    a AS (SELECT r, mask, empty_mask, row_number() OVER (PARTITION BY r ORDER BY image_id) AS k FROM i),
    b AS (SELECT r, empty_mask AS other, row_number() OVER (PARTITION BY r ORDER BY {u_sql(SEED, 'r', 'image_id')}, image_id) AS k FROM i),
    z AS (SELECT r, sum(bit_count(mask & other)) AS hit, sum(bit_count(mask & empty_mask)) AS cited FROM a JOIN b USING (r, k) GROUP BY 1)
    SELECT max(cited)::BIGINT AS observed, avg(hit) AS null_mean, count(*) FILTER (hit <= cited)::DOUBLE / count(*) AS p_value FROM z""", CC, ("null_mean", "p_value"))
def _(t: Tables):
    return S.shuffled_item_null(image_masks(t), t.coverage, 3, SEED)


@query("h5_label_permutation", f"""
    WITH v AS (SELECT o_orderkey AS k, o_totalprice AS x, o_orderpriority = '1-URGENT' AS g FROM orders),
    o AS (SELECT count(*) FILTER (g) AS n, avg(x) FILTER (g) - avg(x) FILTER (NOT g) AS d0 FROM v),
    p AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY {u_sql(SEED, 'r', 'k')}, k) AS rk FROM v, range(3) AS y(r)),
    z AS (SELECT r, avg(x) FILTER (rk <= n) - avg(x) FILTER (rk > n) AS d, max(d0) AS d0 FROM p, o GROUP BY 1)
    SELECT round(max(d0), 6) AS observed, round(avg(d), 6) AS null_mean, count(*) FILTER (d >= d0)::DOUBLE / count(*) AS p_value FROM z""")
def _(t: Tables):
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), (F.col("o_orderpriority") == "1-URGENT").alias("g"))
    return S.label_permutation(rows, "x", "g", 3, SEED, "k").withColumns({c: F.round(c, 6) for c in ("observed", "null_mean")})


@query("h6_random_control", f"""
    WITH m AS ({IMAGE_MASKS}), c AS (SELECT image_id, mask, c, row_number() OVER (PARTITION BY image_id ORDER BY (mask & (1::BIGINT << c::INT)) != 0, {u_sql(SEED, 'image_id', 'c')}, c) AS k FROM m, range(16) AS x(c))
    SELECT *, bit_count(mask & control_mask)::BIGINT AS overlap FROM (SELECT image_id, mask, bit_or(1::BIGINT << c::INT) AS control_mask FROM c WHERE k <= bit_count(mask) GROUP BY image_id, mask)""", ("citations",))
def _(t: Tables):
    return S.random_control(image_masks(t), SEED)


@query("c12_matched_control", f"""
    WITH m AS ({IMAGE_MASKS}), s AS (SELECT i::BIGINT AS subset, bit_count(i) AS size FROM range(65536) AS x(i)),
    tt AS (SELECT image_id, list(tissue_pct ORDER BY cell_idx) AS t FROM coverage GROUP BY 1 HAVING count(*) = 16),
    c AS (SELECT image_id, mask, subset FROM m JOIN s ON size = bit_count(mask) AND bit_count(subset & mask) = greatest(0, 2 * bit_count(mask) - 16) AND subset <> mask),
    g AS (SELECT image_id, mask, subset, round(abs(list_sum([t[i + 1] FOR i IN range(16) IF subset & (1::BIGINT << i::INT) != 0]) - list_sum([t[i + 1] FOR i IN range(16) IF mask & (1::BIGINT << i::INT) != 0])), 6) AS gap
          FROM c JOIN tt USING (image_id))
    SELECT image_id, m.mask, subset AS control_mask, bit_count(subset & m.mask)::BIGINT AS overlap, gap AS tissue_gap FROM m LEFT JOIN (SELECT image_id, subset, gap FROM (
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gap, substr(md5(concat_ws('|', '{SEED}', CAST(image_id AS VARCHAR), CAST(subset AS VARCHAR))), 1, 8), subset) AS k FROM g) WHERE k = 1) USING (image_id)""", CC, ("tissue_gap",))
def _(t: Tables):
    """The whole set that each image's answers cite; one of all 16 cells is a row without control."""
    return S.matched_control(image_masks(t), t.coverage, SEED)


@query("c12_matched_control_whole_sets")
def _(t: Tables):
    """The set that each single answer cites."""
    return S.matched_control(E.cited_cells(t.citations, ["image_id", "prompt_id", "replicate", "seq"]).select("image_id", "mask").distinct(), t.coverage, SEED)


@query("i10_match_quality", """
    SELECT reason, usable, count(*) AS n, max(gap) AS widest FROM (
        SELECT gap, abs(gap) <= 5 AND overlap = 0 AS usable, CASE WHEN abs(gap) <= 5 AND overlap = 0 THEN 'ok' WHEN abs(gap) > 5 AND overlap = 0 THEN 'gap' WHEN abs(gap) <= 5 THEN 'overlap' ELSE 'gap and overlap' END AS reason
        FROM (SELECT round(round(a.tissue_pct, 1) - round(b.tissue_pct, 1), 1) AS gap, a.image_id % 3 AS overlap FROM coverage a JOIN coverage b ON a.image_id = b.image_id AND b.cell_idx = (a.cell_idx + 5) % 16)) GROUP BY ALL""", ("coverage",), ("widest",))
def _(t: Tables):
    from ..operators.tiles import match_quality

    a = t.coverage.select("image_id", ((F.col("cell_idx") + 5) % 16).alias("cell_idx"), F.col("tissue_pct").alias("treated"))
    both = a.join(t.coverage.select("image_id", "cell_idx", F.col("tissue_pct").alias("control")), ["image_id", "cell_idx"]).withColumn("overlap", F.col("image_id") % 3)
    return match_quality(both, "treated", "control").groupBy("reason", "usable").agg(F.count("*").alias("n"), F.max("gap").alias("widest"))


@query("h7_blinded_sample", f"""
    SELECT 'R' || lpad(CAST(k AS VARCHAR), 4, '0') AS rating_id, feature, '' AS presence, '' AS relevance, '' AS support, '' AS notes FROM (
        SELECT feature, row_number() OVER (ORDER BY d, a, b, c, e) AS k FROM (
            SELECT feature, image_id::VARCHAR AS a, replicate::VARCHAR AS b, seq::VARCHAR AS c, item::VARCHAR AS e, {u_sql(SEED, 'image_id', 'replicate', 'seq', 'item')} AS d FROM citations)) WHERE k <= 100""", ("citations",))
def _(t: Tables):
    ids = ["image_id", "replicate", "seq", "item"]
    sheet, _key = S.blinded_sample(t.citations, 100, SEED, ids, ["feature"])
    return sheet


@query("h8_audit_sample", f"SELECT o_orderkey FROM orders ORDER BY {u_sql(42, 'o_orderkey')}, o_orderkey LIMIT 100")
def _(t: Tables):
    return S.seeded_sample(t.orders, 100, 42, "o_orderkey").select("o_orderkey")


@query("h9_seeded_shuffle", f"SELECT o_orderkey, {u_sql(42, 'o_orderkey')} AS draw FROM orders", (), ("draw",))
def _(t: Tables):
    return S.seeded_shuffle(t.orders, 42, "o_orderkey").select("o_orderkey", "draw")


@query("h10_preference_null", """
    WITH n AS (SELECT cell_idx, count(*) AS c FROM (SELECT DISTINCT image_id, prompt_id, replicate, cell_idx FROM citations) GROUP BY 1),
    e AS (SELECT cell_idx, avg((tissue_pct < 5)::INT::DOUBLE) AS e FROM coverage GROUP BY 1)
    SELECT sum(c * e) / sum(c) AS expected_empty_rate FROM (SELECT coalesce(c, 0) AS c, e FROM e LEFT JOIN n USING (cell_idx))""", CC, ("expected_empty_rate",))
def _(t: Tables):
    return S.preference_expectation(E.cell_frequency(t.citations, t.coverage), t.coverage)


@query("e1_dedup_first", "SELECT image_id, replicate, prompt_id, min(seq) AS seq FROM responses GROUP BY ALL", ("responses",))
def _(t: Tables):
    return L.dedup(t.responses, ["image_id", "replicate", "prompt_id"], "first").select("image_id", "replicate", "prompt_id", "seq")


@query("e1_dedup_last", "SELECT image_id, replicate, prompt_id, max(seq) AS seq FROM responses GROUP BY ALL", ("responses",))
def _(t: Tables):
    return L.dedup(t.responses, ["image_id", "replicate", "prompt_id"], "last").select("image_id", "replicate", "prompt_id", "seq")


@query("e4_first_n_per_class", "SELECT * FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_orderpriority) < 50 AS short FROM orders) WHERE rank <= 50")
def _(t: Tables):
    out = S.first_n_per_class(t.orders.select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 50)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("e5_stratified_select", f"""
    WITH b AS (SELECT image_id, label, CASE WHEN ssa_votes IN (0, 7) THEN 'unanimous' WHEN ssa_votes IN (3, 4) THEN 'borderline' ELSE 'strong' END AS band, image_id % 3 = 0 AS rich FROM annotations),
    q AS (SELECT band, label, n FROM (VALUES ('unanimous', 5), ('strong', 3), ('borderline', 1)) AS x(band, n), (VALUES ('HP'), ('SSA')) AS y(label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY band, label, rich ORDER BY {u_sql(SEED, 'image_id')}, image_id) AS k, CASE WHEN n >= 4 THEN (n + 1) // 2 WHEN n >= 2 THEN n ELSE 0 END AS rq FROM b JOIN q USING (band, label))
    SELECT image_id, band, label, rich FROM r WHERE k <= CASE WHEN rich THEN rq ELSE n - rq END""", ("annotations",))
def _(t: Tables):
    items = L.agreement(t.annotations).select("image_id", "label", F.col("agreement_band").alias("band"), (F.col("image_id") % 3 == 0).alias("rich"))
    allocation = t.spark.createDataFrame([(b, lab, n) for b, n in (("unanimous", 5), ("strong", 3), ("borderline", 1)) for lab in ("HP", "SSA")], "band string, label string, n long")
    return S.stratified_select(items, allocation, SEED, ["band", "label"], "rich").select("image_id", "band", "label", "rich")


@query("f1_most_common", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def _(t: Tables):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


@query("f2_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("g2_union_runs", "SELECT run, count(*) AS n, count(label_pred) AS labelled, count(ssa_votes) AS voted FROM (SELECT 'responses' AS run, image_id, label_pred, NULL AS ssa_votes FROM responses UNION ALL SELECT 'annotations', image_id, NULL, ssa_votes FROM annotations) GROUP BY 1", RA)
def _(t: Tables):
    u = L.union_runs({"responses": t.responses.select("image_id", "label_pred"), "annotations": t.annotations.select("image_id", "ssa_votes")})
    return u.groupBy("run").agg(F.count("*").alias("n"), F.count("label_pred").alias("labelled"), F.count("ssa_votes").alias("voted"))


@query("g3_set_operations", "SELECT 'except' AS op, count(*) AS n FROM (SELECT image_id FROM annotations EXCEPT SELECT image_id FROM responses) UNION ALL SELECT 'intersect', count(*) FROM (SELECT image_id FROM annotations INTERSECT SELECT image_id FROM responses)", RA)
def _(t: Tables):
    a, b = t.annotations.select("image_id"), t.responses.select("image_id")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.subtract(b), "except").unionByName(count(a.intersect(b), "intersect"))
