"""Queries on citations and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from .registry import Tables, query

MASKS_SQL = "SELECT image_id, prompt_id, replicate, CAST(bit_or(CAST(1 AS BIGINT) << cell_idx) AS BIGINT) AS mask FROM citations GROUP BY ALL"
JACCARD_SQL = "CASE WHEN bit_count(a.mask | b.mask) = 0 THEN 1.0::DOUBLE ELSE bit_count(a.mask & b.mask)::DOUBLE / bit_count(a.mask | b.mask) END"


def masks(t: Tables):
    return E.cited_cells(t.citations).drop("cells")


@query("b11_cited_cells", f"SELECT image_id, prompt_id, replicate, mask, list_filter(range(16), lambda i: mask & (1::BIGINT << i::INT) != 0)::VARCHAR AS cells FROM ({MASKS_SQL})", ("citations",))
def _(t: Tables):
    return E.cited_cells(t.citations).withColumn("cells", F.concat(F.lit("["), F.array_join(F.col("cells").cast("array<string>"), ", "), F.lit("]")))


@query("b12_citation_pairs", "SELECT feature, substr('ABCD', 1 + cell_idx // 4, 1) || (cell_idx % 4 + 1) AS cell, count(*) AS n FROM citations GROUP BY ALL", ("citations",))
def _(t: Tables):
    return E.citation_pairs(E.nested(t.citations)).groupBy("feature", "cell").agg(F.count("*").alias("n"))


@query("b13_evidence_items", "SELECT prompt_id, feature, count(*) AS n, sum(k)::BIGINT AS n_cells FROM (SELECT image_id, prompt_id, replicate, item, feature, count(*) AS k FROM citations WHERE feature <> 'stroma' GROUP BY ALL) GROUP BY ALL", ("citations",))
def _(t: Tables):
    items = E.evidence_items(E.nested(t.citations), ["architecture", "serration"])
    return items.groupBy("prompt_id", "feature").agg(F.count("*").alias("n"), F.sum(F.size("cells").cast("long")).alias("n_cells"))


@query("b14_parse_cells", "SELECT l_returnflag, count(*) AS n, sum(CASE WHEN l_linenumber BETWEEN 1 AND 4 THEN 1 ELSE 0 END)::BIGINT AS n_valid, sum(CASE WHEN l_linenumber BETWEEN 1 AND 4 THEN 0 ELSE 1 END)::BIGINT AS n_invalid FROM lineitem GROUP BY ALL")
def _(t: Tables):
    text = F.concat(F.lit(" a"), F.col("l_linenumber").cast("string"), F.lit(" ; ,A"), F.col("l_linenumber").cast("string"))
    good, bad = E.parse_cells(text)
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.size(good).cast("long")).alias("n_valid"), F.sum(F.size(bad).cast("long")).alias("n_invalid"))


@query("b15_cell_geometry", """
    SELECT cell, touches_border, count(*) AS n FROM (
        SELECT substr('ABCD', 1 + cell_idx // 4, 1) || (cell_idx % 4 + 1) AS cell, NOT (cell_idx // 4 IN (1, 2) AND cell_idx % 4 IN (1, 2)) AS touches_border FROM citations)
    GROUP BY ALL""", ("citations",))
def _(t: Tables):
    return t.citations.join(F.broadcast(E.cell_geometry(t.spark)), "cell_idx").groupBy("cell", "touches_border").agg(F.count("*").alias("n"))


@query("c1_with_coverage", "SELECT feature, count(*) AS n, avg(tissue_pct) AS mean_tissue FROM citations JOIN coverage USING (image_id, cell_idx) GROUP BY ALL", ("citations", "coverage"), ("mean_tissue",))
def _(t: Tables):
    return E.with_coverage(t.citations, t.coverage).groupBy("feature").agg(F.count("*").alias("n"), F.avg("tissue_pct").alias("mean_tissue"))


@query("d5_empty_citations", """
    WITH cited AS (SELECT DISTINCT image_id, prompt_id, replicate, cell_idx FROM citations),
    tiles AS (SELECT image_id, count(*) FILTER (tissue_pct < 5)::DOUBLE / count(*) AS uniform FROM coverage GROUP BY 1),
    per AS (SELECT image_id, prompt_id, replicate, count(*) AS n, count(*) FILTER (tissue_pct < 5) AS e, min(tissue_pct) AS low, avg(tissue_pct) AS mean
            FROM cited JOIN coverage USING (image_id, cell_idx) GROUP BY ALL)
    SELECT prompt_id, count(*) AS responses, sum(n)::BIGINT AS n_cited, sum(e)::BIGINT AS n_empty, sum(e)::DOUBLE / sum(n) AS empty_rate,
           sum(n * uniform) / sum(n) AS uniform_rate, min(low) AS min_tissue, avg(mean) AS mean_tissue
    FROM per JOIN tiles USING (image_id) GROUP BY 1""", ("citations", "coverage"), ("empty_rate", "uniform_rate", "mean_tissue"))
def _(t: Tables):
    return E.empty_citations(t.citations, t.coverage, ["prompt_id"])


@query("d5_empty_by_feature", "SELECT feature, count(*) AS n_cited, count(*) FILTER (round(tissue_pct, 1) < 5) AS n_empty FROM citations JOIN coverage USING (image_id, cell_idx) GROUP BY 1", ("citations", "coverage"))
def _(t: Tables):
    return E.empty_by_feature(t.citations, t.coverage)


@query("d1_validity_summary", """
    WITH r AS (SELECT image_id, prompt_id, replicate, count(*) FILTER (cell_idx < 14) AS v, count(*) FILTER (cell_idx >= 14) AS b FROM citations GROUP BY ALL)
    SELECT count(*) AS responses, count(*) AS parsed, 0::BIGINT AS parse_failures, sum(v)::BIGINT AS valid_citations, sum(b)::BIGINT AS invalid_citations,
           sum(b)::DOUBLE / greatest(sum(v + b), 1) AS invalid_rate, count(*) FILTER (b > 0) AS responses_with_invalid FROM r""", ("citations",), ("invalid_rate",))
def _(t: Tables):
    ok = F.col("cell_idx") < 14
    r = t.citations.groupBy(*E.RESPONSE).agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid")).withColumn("parsed", F.lit(True))
    return E.validity_summary(r)


@query("d2_violation_kinds", "SELECT kind, count(*) AS n FROM (SELECT split_part(split_part(p_name, ' ', 1), '[', 1) AS kind FROM part) GROUP BY 1 ORDER BY n DESC, kind LIMIT 10")
def _(t: Tables):
    return E.violation_kinds(t.part.select(F.array("p_name").alias("violations")))


@query("d3_cell_frequency", """
    WITH cited AS (SELECT DISTINCT image_id, prompt_id, replicate, cell_idx FROM citations),
    total AS (SELECT count(*) AS responses FROM (SELECT DISTINCT image_id, prompt_id, replicate FROM cited)),
    n AS (SELECT cell_idx, count(*) AS c FROM cited GROUP BY 1),
    a AS (SELECT cell_idx, cell, count(*) FILTER (tissue_pct >= 5) AS n_available FROM coverage GROUP BY ALL)
    SELECT cell, coalesce(c, 0) AS n_cited, n_available, coalesce(c, 0)::DOUBLE / greatest(responses, 1) AS cited_share
    FROM a LEFT JOIN n USING (cell_idx) CROSS JOIN total""", ("citations", "coverage"), ("cited_share",))
def _(t: Tables):
    return E.cell_frequency(t.citations, t.coverage)


@query("d6_transposition", """
    WITH cited AS (SELECT DISTINCT image_id, prompt_id, replicate, cell_idx, (cell_idx % 4) * 4 + cell_idx // 4 AS swapped FROM citations)
    SELECT count(*) AS n_cited, count(*) FILTER (c.cell_idx = swapped) AS on_diagonal,
           count(*) FILTER (c.cell_idx <> swapped AND a.tissue_pct > b.tissue_pct) AS as_is_better,
           count(*) FILTER (c.cell_idx <> swapped AND a.tissue_pct < b.tissue_pct) AS turned_better, avg(a.tissue_pct) AS mean_as_is, avg(b.tissue_pct) AS mean_turned,
           count(*) FILTER (a.tissue_pct < 5 AND b.tissue_pct >= 5) AS rescued
    FROM cited c JOIN coverage a ON a.image_id = c.image_id AND a.cell_idx = c.cell_idx JOIN coverage b ON b.image_id = c.image_id AND b.cell_idx = c.swapped""",
    ("citations", "coverage"), ("mean_as_is", "mean_turned"))
def _(t: Tables):
    return E.transposition(t.citations, t.coverage)


@query("c9_replicate_pairs", f"""
    WITH m AS ({MASKS_SQL})
    SELECT a.prompt_id, count(*) AS n_pairs, avg({JACCARD_SQL}) AS mean_jaccard
    FROM m a JOIN m b ON a.image_id = b.image_id AND a.prompt_id = b.prompt_id AND a.replicate < b.replicate GROUP BY 1""", ("citations",), ("mean_jaccard",))
def _(t: Tables):
    pairs = E.replicate_pairs(masks(t), ["image_id", "prompt_id"])
    return pairs.groupBy("prompt_id").agg(F.count("*").alias("n_pairs"), F.avg("jaccard").alias("mean_jaccard"))


_PAIRS = f"SELECT a.image_id, a.prompt_id, avg({JACCARD_SQL}) AS mj FROM m a JOIN m b ON a.image_id = b.image_id AND a.prompt_id = b.prompt_id AND a.replicate < b.replicate GROUP BY ALL"
_CELLS = """SELECT image_id, prompt_id, count(*) FILTER (k = n) AS cells_in_all, count(*) FILTER (k = 1) AS cells_in_one, count(*) AS union_cells, sum(k) AS cited
    FROM (SELECT image_id, prompt_id, i, count(*) FILTER (mask & (1::BIGINT << i::INT) != 0) AS k, count(*) AS n FROM m, range(16) AS c(i) GROUP BY ALL) WHERE k > 0 GROUP BY ALL"""


@query("d4_replicate_stability", f"""
    WITH m AS ({MASKS_SQL}), p AS ({_PAIRS}), c AS ({_CELLS}), n AS (SELECT image_id, prompt_id, count(*) AS n_reps FROM m GROUP BY ALL)
    SELECT image_id, prompt_id, n_reps, mj AS mean_jaccard, cells_in_all, cells_in_one, cited::DOUBLE / n_reps AS mean_cells
    FROM n JOIN p USING (image_id, prompt_id) JOIN c USING (image_id, prompt_id) WHERE n_reps >= 2""", ("citations",), ("mean_jaccard", "mean_cells"))
def _(t: Tables):
    return E.replicate_stability(masks(t), ["image_id", "prompt_id"])


@query("d28_stability_probe", f"""
    WITH m AS ({MASKS_SQL}), p AS ({_PAIRS}), c AS ({_CELLS}), n AS (SELECT image_id, prompt_id, count(*) AS n_reps FROM m GROUP BY ALL)
    SELECT count(*) AS groups, avg(coalesce(mj, 0)) AS mean_jaccard, (SELECT avg(j) FROM (SELECT {JACCARD_SQL} AS j FROM m a JOIN m b ON a.image_id = b.image_id AND a.prompt_id = b.prompt_id AND a.replicate < b.replicate)) AS pair_jaccard,
           avg(cited::DOUBLE / n_reps) AS mean_cells, sum(cells_in_all)::DOUBLE / greatest(sum(union_cells), 1) AS core_share
    FROM n LEFT JOIN p USING (image_id, prompt_id) JOIN c USING (image_id, prompt_id)""", ("citations",), ("mean_jaccard", "pair_jaccard", "mean_cells", "core_share"))
def _(t: Tables):
    return E.stability_probe(masks(t), ["image_id", "prompt_id"])


@query("d28_label_stability", """
    SELECT image_id, prompt_id, count(*) AS n_reps, string_agg(label_pred, ',' ORDER BY replicate, seq, label_pred, confidence) AS labels, string_agg(CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY replicate, seq, label_pred, confidence) AS confidences,
           count(DISTINCT label_pred) = 1 AS label_stable
    FROM responses WHERE label_pred IS NOT NULL GROUP BY ALL""", ("responses",))
def _(t: Tables):
    h = E.response_history(t.responses, ["image_id", "prompt_id"])
    percent = F.transform("confidences", lambda c: F.round(c * 100).cast("long").cast("string"))
    return h.select("image_id", "prompt_id", "n_reps", F.array_join("labels", ",").alias("labels"), F.array_join(percent, ",").alias("confidences"), "label_stable")


@query("c10_between_item_similarity", f"""
    WITH m AS (SELECT prompt_id, mask, count(*) AS n FROM ({MASKS_SQL}) GROUP BY ALL),
    w AS (SELECT a.prompt_id, CASE WHEN a.mask = b.mask THEN a.n * (a.n - 1) / 2.0::DOUBLE ELSE a.n * b.n::DOUBLE END AS w, {JACCARD_SQL} AS j
          FROM m a JOIN m b ON a.prompt_id = b.prompt_id AND a.mask <= b.mask)
    SELECT prompt_id, sum(w) AS n_pairs, sum(w * j) / sum(w) AS mean_jaccard FROM w GROUP BY 1""", ("citations",), ("mean_jaccard",))
def _(t: Tables):
    return E.between_item_similarity(masks(t), ["prompt_id"])


@query("e2_top_k_cells", """
    SELECT image_id, cell, tissue_pct, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tissue_pct DESC, cell) AS rank
        FROM (SELECT DISTINCT image_id, cell_idx FROM citations) JOIN coverage USING (image_id, cell_idx)) WHERE rank <= 3""", ("citations", "coverage"))
def _(t: Tables):
    return E.top_k_cells(t.citations, t.coverage, 3).select("image_id", "cell", "tissue_pct", F.col("rank").cast("long").alias("rank"))


@query("i17_flagged_panel", """
    SELECT image_id, string_agg(cell, ',' ORDER BY cell) AS cited, coalesce(string_agg(cell, ',' ORDER BY cell) FILTER (tissue_pct < 5), '') AS on_empty,
           count(*) FILTER (tissue_pct < 5) AS n_empty, CASE WHEN count(*) FILTER (tissue_pct < 5) > 0 THEN 'cites empty' ELSE 'ok' END AS verdict
    FROM (SELECT DISTINCT image_id, cell_idx FROM citations) JOIN coverage USING (image_id, cell_idx) GROUP BY 1""", ("citations", "coverage"))
def _(t: Tables):
    return E.flagged_panel(t.citations, t.coverage)


@query("e6_ordered_history", """
    SELECT image_id, string_agg(coalesce(label_pred, '-'), ',' ORDER BY replicate, seq) AS labels FROM responses WHERE prompt_id = 'cte_p1' GROUP BY 1""", ("responses",))
def _(t: Tables):
    rows = t.responses.where("prompt_id = 'cte_p1'").withColumn("label", F.coalesce("label_pred", F.lit("-"))).withColumn("at", F.struct("replicate", "seq"))
    return E.ordered_history(rows, ["image_id"], "at", "label").select("image_id", F.array_join("label", ",").alias("labels"))


@query("g1_jaccard", f"""
    WITH m AS (SELECT image_id, prompt_id, CAST(bit_or(CAST(1 AS BIGINT) << cell_idx) AS BIGINT) AS mask FROM citations GROUP BY ALL)
    SELECT count(*) AS items, avg({JACCARD_SQL}) AS mean_jaccard FROM m a JOIN m b ON a.image_id = b.image_id WHERE a.prompt_id = 'cte_p1' AND b.prompt_id = 'etc_p1'""", ("citations",), ("mean_jaccard",))
def _(t: Tables):
    from ..functions.columns import jaccard_masks
    from ..operators.contrast import pair_conditions

    m = E.cited_cells(t.citations, ["image_id", "prompt_id"])
    both = pair_conditions(m.where("prompt_id = 'cte_p1'").select("image_id", "mask"), m.where("prompt_id = 'etc_p1'").select("image_id", "mask"))
    return both.agg(F.count("*").alias("items"), F.avg(jaccard_masks("mask_a", "mask_b")).alias("mean_jaccard"))
