"""Queries on ledgers, checks, caches, costs, text, scoring and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import evidence as E
from ..operators import ledger as L
from ..operators import scoring as SC
from ..operators import tiles as TI
from ..operators import wording as WO
from ..sources import files as FI
from ..sources import keyed
from ..sources.commits import Log
from ..sources.shared import fresh_folder
from ..streaming import calls as ST
from . import fixtures
from .contrasts import _STOP, RA
from .registry import Tables, query


@query("a1_ledger", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS bad FROM events")
def _(t: Tables):
    out = FI.parse_ledger(t.events.select("event_id", "props"), "props", "k BIGINT")
    return out.select("event_id", "record.k", "bad")


@query("a1_read_ledger", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS key, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    """Written as lines in the order of events, with blank ones, and read back: of each key the last line."""
    path, line = fresh_folder(t.spark, "lines"), F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
    in_order = t.events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    in_order.select(F.concat(line, F.when(F.col("event_id") % 7 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    ledger = FI.read_ledger(t.spark, path, "event_id BIGINT, k BIGINT").withColumn("key", F.col("k") % 10)
    last = L.dedup(ledger.select("key", "event_id", "seq"), ["key"], "last").select("key", "event_id")
    return last.join(ledger.groupBy("key").agg(F.count("*").alias("n")), "key")


@query("a3_read_annotations", "SELECT label, count(*) AS n, sum(ssa_votes)::BIGINT AS votes FROM annotations WHERE partition = 'test' GROUP BY 1", ("annotations",))
def _(t: Tables):
    path = fresh_folder(t.spark, "annotations")
    names = {"image_id": "Image Name", "label": "Majority Vote Label", "ssa_votes": "Number of Annotators who Selected SSA (Out of 7)", "partition": "Partition"}
    t.annotations.select(*[F.col(c).alias(n) for c, n in names.items()]).write.option("header", True).csv(path)
    return FI.read_annotations(t.spark, path, names, "test").groupBy("label").agg(F.count("*").alias("n"), F.sum("ssa_votes").alias("votes"))


@query("a2_append_ledger", "SELECT experiment, count(*) AS n, sum(output_tokens)::BIGINT AS tokens FROM calls GROUP BY 1", ("calls",))
def _(t: Tables):
    """In two batches; one is appended again, another breaks off before its commit: both count once."""
    path = fresh_folder(t.spark, "ledger")
    for batch in ("even", "odd", "even"):
        rows = t.calls.where(F.col("seq") % 2 == int(batch == "odd"))
        if batch == "odd":
            Log(t.spark, path).write_files(rows)
        FI.append_ledger(rows, path, batch)
    return FI.committed_ledger(t.spark, path, seq="place").groupBy("experiment").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"))


@query("a1_order_of_batches", """
    SELECT experiment, image_id, first(seq ORDER BY seq % 3 DESC, seq) AS first_call, last(seq ORDER BY seq % 3 DESC, seq) AS last_call, count(*) AS n FROM calls GROUP BY ALL""", ("calls",))
def _(t: Tables):
    """Appended in three batches whose numbers fall, lines in the order of calls: first and last call of each item as they were appended."""
    path = fresh_folder(t.spark, "ledger")
    for part in (2, 1, 0):
        rows = t.calls.where(F.col("seq") % 3 == part).select("experiment", "image_id", F.col("seq").alias("call"))
        FI.append_ledger(rows.repartitionByRange(4, "call").sortWithinPartitions("call"), path, f"part {part}")
    ledger, keys = FI.committed_ledger(t.spark, path).select("experiment", "image_id", "call", "seq"), ["experiment", "image_id"]
    ends = [L.dedup(ledger, keys, keep).select(*keys, F.col("call").alias(f"{keep}_call")) for keep in ("first", "last")]
    return ends[0].join(ends[1], keys).join(ledger.groupBy(*keys).agg(F.count("*").alias("n")), keys)


@query("a4_read_tiles", f"""
    WITH pixels AS ({fixtures.VIEWS["pixels"].replace("o_orderkey", "s_suppkey").replace("FROM orders", "FROM supplier")}), bad AS (SELECT *, image_id % 10 = 3 AS bad FROM pixels)
    SELECT image_id, CASE WHEN NOT bad THEN 8 END AS height, CASE WHEN NOT bad THEN 8 END AS width, CASE WHEN bad THEN 'not an image' END AS error,
           CASE WHEN NOT bad THEN sum(r)::BIGINT END AS r, CASE WHEN NOT bad THEN sum(g)::BIGINT END AS g, CASE WHEN NOT bad THEN sum(b * (x + 1))::BIGINT END AS weighted FROM bad GROUP BY image_id, bad""")
def _(t: Tables):
    """Images written to the shared folder, some of them cut off, and read back, each once, into a table of tiles: every one is a row."""
    made = FI.encode_tiles(fixtures.tiles(t.supplier.select(F.col("s_suppkey").alias("image_id"))))
    path = fresh_folder(t.spark, "images")
    FI.write_images(made.withColumn("data", F.when(F.col("image_id") % 10 == 3, F.substring("data", 1, 20)).otherwise(F.col("data"))), path)
    table = fresh_folder(t.spark, "tiles")
    FI.read_tiles(t.spark, path).write.parquet(table)
    found = t.spark.read.parquet(table)
    sums = TI.mapped(found, lambda rgb, rows: {"r": rgb[..., 0].sum(axis=(1, 2), dtype="int64"), "g": rgb[..., 1].sum(axis=(1, 2), dtype="int64"), "weighted": (rgb[..., 2].astype("int64").sum(axis=1) * range(1, 9)).sum(axis=1)}, "r long, g long, weighted long")
    return found.select("image_id", "height", "width", "error").join(sums, "image_id", "left")


@query("a5_missing_files", "SELECT image_id FROM annotations WHERE image_id NOT IN (SELECT image_id FROM responses WHERE label_pred IS NOT NULL)", RA)
def _(t: Tables):
    return FI.missing_files(t.annotations.select("image_id"), t.responses.where("label_pred IS NOT NULL"), "image_id", "image_id")


@query("a6_coverage_rows", "SELECT image_id AS image, cell, tissue_pct FROM coverage", ("coverage",))
def _(t: Tables):
    docs = t.coverage.groupBy(F.col("image_id").alias("image")).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("tissue_pct")))).alias("cells"))
    return FI.coverage_rows(docs)


@query("a7_coverage_index", "SELECT image_id, min(tissue_pct) AS min_cell_pct, max(tissue_pct) AS max_cell_pct, count(*) FILTER (tissue_pct < 5) AS n_empty FROM coverage GROUP BY 1", ("coverage",))
def _(t: Tables):
    return FI.coverage_documents(t.coverage.withColumn("is_empty", F.col("tissue_pct") < 5)).drop("cells")


@query("a8_stream_split", "SELECT image_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY image_id) - 1 AS ordinal FROM annotations) WHERE partition = 'test' AND ordinal < 1000", ("annotations",))
def _(t: Tables):
    from ..operators.ranks import with_ahead

    return FI.stream_split(with_ahead(t.annotations, ["partition"], "image_id", name="ordinal"), "test", 1000).select("image_id", "ordinal")


@query("a9_manifest", "SELECT partition, label, CAST(floor(image_id / 4096) AS BIGINT) AS part, '{\"seed\":42,\"items\":[' || string_agg('{\"image_id\":' || image_id || ',\"ssa_votes\":' || ssa_votes || '}', ',' ORDER BY image_id) || ']}' AS document, count(*) AS n_items FROM annotations GROUP BY ALL", ("annotations",))
def _(t: Tables):
    return FI.manifest(t.annotations, ["partition", "label"], "image_id", "ssa_votes", seed=42)


PROMPTS = [("co_p1", "co", "plain"), ("cte_p1", "cte", "plain"), ("etc_p1", "etc", "expert")]
_PROMPTS_SQL = "(VALUES ('co_p1', 'co', 'plain'), ('cte_p1', 'cte', 'plain'), ('etc_p1', 'etc', 'expert')) AS d(prompt_id, condition, voice)"


@query("a10_dimension", f"SELECT condition, voice, count(*) AS n FROM responses JOIN {_PROMPTS_SQL} USING (prompt_id) GROUP BY ALL", ("responses",))
def _(t: Tables):
    dim = t.spark.createDataFrame(PROMPTS, "prompt_id string, condition string, voice string")
    return t.responses.join(F.broadcast(dim), "prompt_id").groupBy("condition", "voice").agg(F.count("*").alias("n"))


@query("a11_check_embeddings", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS bad_length, count(*) FILTER (label IS NULL) AS null_label FROM embeddings")
def _(t: Tables):
    return FI.check_embeddings(t.embeddings, "embedding", "label", 64)


@query("a12_prediction_cache", """
    WITH w AS (SELECT image_id, seq % 3 AS batch, max(seq) AS seq FROM calls GROUP BY ALL), l AS (SELECT image_id, last(seq ORDER BY batch) AS seq FROM w GROUP BY 1)
    SELECT substr(sha256(CAST(image_id AS VARCHAR)), 1, 1) AS first, count(*) AS n, sum(seq)::BIGINT AS seqs FROM l WHERE image_id IN (SELECT image_id FROM calls WHERE failed) GROUP BY 1""", ("calls",))
def _(t: Tables):
    """Three writes of the same keys, the first two merged, one write repeated: a lookup finds the latest row of each key."""
    path = fresh_folder(t.spark, "cache")
    keyed_calls = t.calls.withColumn("cache_key", F.sha2(F.col("image_id").cast("string"), 256))
    for part in (0, 1, 2, 2):
        rows = keyed_calls.where(F.col("seq") % 3 == part).groupBy("cache_key").agg(F.max("seq").alias("seq"))
        FI.write_cache(rows, path, batch=f"part {part}")
        if part == 1:
            keyed.compact(t.spark, path, "cache_key")
    found = FI.read_cache(t.spark, path, keyed_calls.where("failed"))
    return found.groupBy(F.substring("cache_key", 1, 1).alias("first")).agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


_ANSWER = "'{\"label\":\"' || coalesce(label_pred, '') || '\",\"confidence\":0.5,\"evidence\":[]}'"


@query("b1_extract_json", "SELECT kind, count(*) AS n FROM (SELECT CASE replicate % 3 WHEN 0 THEN 'no opening brace' WHEN 1 THEN 'unbalanced braces' ELSE 'ok' END AS kind FROM responses) GROUP BY 1", ("responses",))
def _(t: Tables):
    r = F.col("replicate") % 3
    raw = F.when(r == 0, "no answer }").when(r == 1, F.concat(F.lit('text {"a": "}'), F.coalesce("label_pred", F.lit("?")))).otherwise(F.concat(F.lit('so: ```json\n{"a": {"b": "{"}, "c": "'), F.coalesce("label_pred", F.lit("?")), F.lit('"}\n``` and {more')))
    out = t.responses.select(A.extract_json(raw).alias("x")).select(F.coalesce("x.error", F.when(F.try_parse_json("x.payload").isNotNull(), "ok")).alias("kind"))
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("b2_key_order", "SELECT array_to_string(json_keys(props), '>') AS key_order, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    return A.key_order_histogram(t.events, "props")


@query("d26_key_order_histogram", "SELECT CASE WHEN replicate % 2 = 0 THEN 'label>confidence>evidence' ELSE 'evidence>label' END AS key_order, count(*) AS n FROM responses GROUP BY 1", ("responses",))
def _(t: Tables):
    payload = F.when(F.col("replicate") % 2 == 0, '{"label": 1, "confidence": {"x": 1}, "evidence": []}').otherwise('{"evidence": [], "label": 2}')
    return A.key_order_histogram(t.responses.withColumn("payload", payload), "payload")


@query("b5_key_order_valid", "SELECT prompt_id, count(*) FILTER (replicate % 2 = 0) AS n_ok, count(*) AS n FROM responses GROUP BY 1", ("responses",))
def _(t: Tables):
    payload = F.when(F.col("replicate") % 2 == 0, '{"label": 1, "evidence": []}').otherwise('{"evidence": [], "label": 2}')
    rows = t.responses.withColumns({"payload": payload, "declared": F.array(F.lit("label"), F.lit("evidence"))})
    return A.key_order_valid(rows, "payload", "declared").groupBy("prompt_id").agg(F.count_if("key_order_ok").alias("n_ok"), F.count("*").alias("n"))


def _raw(t: Tables):
    nested = E.nested(t.citations).join(t.responses.groupBy(*E.RESPONSE).agg(F.max("label_pred").alias("label_pred"), F.max("confidence").alias("confidence")), E.RESPONSE)
    return A.stated(nested)


_BY_RESPONSE = "(SELECT image_id, prompt_id, replicate, max(label_pred) AS label_pred FROM responses GROUP BY ALL)"


@query("b3_validate_lenient", f"SELECT prompt_id, count(*) AS n, count(*) FILTER (label_pred IS NULL) AS with_violations FROM {_BY_RESPONSE} GROUP BY 1", ("responses",))
def _(t: Tables):
    out = A.validate(_raw(t), "raw", A.Protocol())
    return out.groupBy("prompt_id").agg(F.count("*").alias("n"), F.count_if(F.size("violations") > 0).alias("with_violations"))


@query("b4_validate_strict", f"SELECT prompt_id, count(*) FILTER (label_pred IS NOT NULL) AS good, count(*) FILTER (label_pred IS NULL) AS quarantined FROM {_BY_RESPONSE} GROUP BY 1", ("responses",))
def _(t: Tables):
    """An answer's violations depend on its text alone, so equal answers are validated as one, with their number."""
    answers = _raw(t).groupBy("prompt_id", "raw").agg(F.count("*").alias("n"))
    good, bad = A.split_valid(A.validate(answers, "raw", A.Protocol(), strict=True).select("prompt_id", "n", "violations"))
    tagged = good.select("prompt_id", "n", F.lit(True).alias("g")).unionByName(bad.select("prompt_id", "n", F.lit(False).alias("g")))
    number = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    return tagged.groupBy("prompt_id").agg(number(F.col("g")).alias("good"), number(~F.col("g")).alias("quarantined"))


@query("b6_protocol", "SELECT feature, count(*) AS n FROM citations WHERE feature IN ('serration', 'stroma') GROUP BY 1", ("citations",))
def _(t: Tables):
    dim = A.protocol_dim(t.spark, {"mhist": A.Protocol(features=("serration", "stroma"))}).select(F.explode("features").alias("feature"))
    return t.citations.join(F.broadcast(dim), "feature").groupBy("feature").agg(F.count("*").alias("n"))


@query("b7a_check_annotations", """
    SELECT 'null_key' AS rule, count(*) FILTER (image_id IS NULL) AS n_bad FROM annotations UNION ALL SELECT 'bad_label', count(*) FILTER (label NOT IN ('HP', 'SSA')) FROM annotations
    UNION ALL SELECT 'bad_partition', count(*) FILTER (partition NOT IN ('train', 'test')) FROM annotations UNION ALL SELECT 'bad_votes', count(*) FILTER (ssa_votes NOT BETWEEN 0 AND 7) FROM annotations
    UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT image_id FROM annotations GROUP BY 1 HAVING count(*) > 1)""", ("annotations",))
def _(t: Tables):
    return L.check_annotations(t.annotations)


@query("b7b_check_runs", "SELECT 'confidence_range' AS rule, count(*) FILTER (c < 0 OR c > 1) AS n_bad FROM (SELECT confidence * 1.5 AS c FROM responses) UNION ALL SELECT 'agreement_range', 0 UNION ALL SELECT 'prompt_prefix', 0", RA)
def _(t: Tables):
    return L.check_runs(t.responses.join(t.annotations, "image_id").withColumn("confidence", F.col("confidence") * 1.5))


@query("b8_check_predictions", "SELECT 'bad_label' AS rule, count(*) FILTER (label_pred IS NULL) AS n_bad FROM responses UNION ALL SELECT 'bad_confidence', 0 UNION ALL SELECT 'blank_model', count(*) FILTER (replicate = 7) FROM responses", ("responses",))
def _(t: Tables):
    return L.check_predictions(t.responses.withColumn("model", F.when(F.col("replicate") == 7, " ").otherwise("m")))


@query("b9_agreement", "SELECT image_id, greatest(ssa_votes, 7 - ssa_votes) AS agreement, CASE WHEN ssa_votes IN (0, 7) THEN 'unanimous' WHEN ssa_votes IN (3, 4) THEN 'borderline' ELSE 'strong' END AS agreement_band FROM annotations", ("annotations",))
def _(t: Tables):
    return L.agreement(t.annotations).select("image_id", "agreement", "agreement_band")


@query("b10_index_labels", "SELECT CASE label WHEN 'HP' THEN 0 ELSE 1 END::BIGINT AS label_index, 'img_' || partition || '_' || lpad(CAST(image_id AS VARCHAR), 8, '0') AS sample_id FROM annotations", ("annotations",))
def _(t: Tables):
    return L.index_labels(t.annotations, "label", ("HP", "SSA"), "img_%s_%08d", "partition", "image_id").select("label_index", "sample_id")


# Words of the tables' own text, as stand-ins for findings.
_PLACES = [("oread", "upper_confined", "HP"), ("brown", "upper_confined", "HP"), ("the th", "base_extending", "SSA"), ("red", "base_extending", "SSA"), (" of ", "throughout", "SSA")]


def _case(words, at: int, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{w[0]}') THEN '{w[at]}'" for w in words) + f" ELSE '{otherwise}' END"


@query("b16_classify_location", f"SELECT doc_id, {_case(_PLACES, 1, 'no_location')} AS kind, {_case(_PLACES, 2, 'none')} AS direction FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", WO.classify_location("text", _PLACES).alias("c")).select("doc_id", "c.kind", "c.direction")


@query("b17_classify_architecture", f"SELECT kind, direction, count(*) AS n FROM (SELECT {_case(WO.ARCHITECTURE, 1, 'generic')} AS kind, {_case(WO.ARCHITECTURE, 2, 'none')} AS direction FROM documents) GROUP BY ALL")
def _(t: Tables):
    return t.documents.select(WO.classify_architecture("text").alias("c")).groupBy("c.kind", "c.direction").agg(F.count("*").alias("n"))


@query("b18_criterion_terms", "SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), 'tion') THEN 'a' END, CASE WHEN regexp_matches(lower(text), 'e(au|en)') THEN 'b' END], lambda x: x IS NOT NULL), ',') AS terms FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.array_join(WO.criterion_terms("text", [("a", "tion"), ("b", "e(au|en)")]), ",").alias("terms"))


_RUBRIC = [("architecture", "primary", None), ("serration", "primary", None), ("stroma", "secondary", "HP")]
_ITEMS = "(SELECT *, CASE cell_idx % 3 WHEN 0 THEN 'HP' WHEN 1 THEN 'SSA' ELSE 'none' END AS direction FROM citations)"


def _directed(t: Tables):
    r = F.col("cell_idx") % 3
    return t.citations.withColumn("direction", F.when(r == 0, "HP").when(r == 1, "SSA").otherwise("none"))


@query("b19_rubric_relevance", f"""
    SELECT relevance, support, downgraded, count(*) AS n FROM (
        SELECT CASE WHEN rel = 'primary' AND direction = 'none' THEN 'none' ELSE rel END AS relevance, rel = 'primary' AND direction = 'none' AS downgraded,
               CASE WHEN direction <> 'none' THEN direction WHEN rel = 'primary' THEN 'none' ELSE coalesce(sup, 'none') END AS support
        FROM {_ITEMS} JOIN (VALUES ('architecture', 'primary', NULL), ('serration', 'primary', NULL), ('stroma', 'secondary', 'HP')) AS r(feature, rel, sup) USING (feature)) GROUP BY ALL""", ("citations",))
def _(t: Tables):
    rubric = t.spark.createDataFrame(_RUBRIC, "feature string, relevance string, supports string")
    return WO.rubric_relevance(_directed(t), rubric).groupBy("relevance", "support", "downgraded").agg(F.count("*").alias("n"))


@query("d29_description_report", f"""
    SELECT feature, count(*) AS n, count(*) FILTER (direction <> 'none') AS directional, count(*) FILTER (direction = 'none') AS downgraded, count(*) FILTER (direction <> 'none' AND direction = (CASE WHEN i.replicate % 2 = 0 THEN 'HP' ELSE 'SSA' END)) AS matches_stated,
           count(*) FILTER (direction <> 'none' AND direction = label) AS matches_true, count(*)::BIGINT AS terms FROM {_ITEMS} i JOIN annotations a USING (image_id) GROUP BY 1""", ("citations", "annotations"))
def _(t: Tables):
    return WO.description_report(_described(t).join(t.annotations, "image_id"), ["feature"])


def _described(t: Tables):
    kind = F.concat(F.lit("k"), (F.col("cell_idx") % 3).cast("string"))
    return _directed(t).withColumns({"stated": F.when(F.col("replicate") % 2 == 0, "HP").otherwise("SSA"), "terms": F.array("feature"), "kind": kind})


@query("d29_class_counts", "SELECT feature, 'k' || (cell_idx % 3) AS kind, count(*) AS n FROM citations GROUP BY ALL", ("citations",))
def _(t: Tables):
    return WO.class_counts(_described(t), ["feature"])


@query("d29_inconsistent_items", f"SELECT image_id, replicate, item, direction FROM {_ITEMS} WHERE direction <> 'none' AND direction <> CASE WHEN replicate % 2 = 0 THEN 'HP' ELSE 'SSA' END", ("citations",))
def _(t: Tables):
    return WO.inconsistent_items(_described(t).join(t.annotations, "image_id")).select("image_id", "replicate", "item", "direction")


@query("b20_content_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))) AS token FROM documents) GROUP BY 1")
def _(t: Tables):
    return t.documents.select(F.explode(WO.content_tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_BLOCKS = [("co_p1", 2, "Answer only."), ("co_p1", 1, "Look at the tile."), ("cte_p1", 1, "Explain, then answer.")]


@query("b21_render_requests", "SELECT image_id, prompt_id, prompt, sha256(image_id || '|' || prompt) AS request_sha256 FROM annotations, (VALUES ('co_p1', E'Look at the tile.\\n\\nAnswer only.'), ('cte_p1', 'Explain, then answer.')) AS p(prompt_id, prompt)", ("annotations",))
def _(t: Tables):
    blocks = t.spark.createDataFrame(_BLOCKS, "prompt_id string, block_no int, body string")
    return WO.render_requests(t.annotations.select("image_id"), blocks)


@query("b22_lint_prompts", "SELECT rule, term, count(text) AS n_texts FROM (VALUES ('leak', 'License'), ('leak', 'SSA'), ('voice', 'eau ')) AS t(rule, term) LEFT JOIN documents ON contains(lower(text), lower(term)) GROUP BY ALL")
def _(t: Tables):
    terms = t.spark.createDataFrame([("leak", "License"), ("leak", "SSA"), ("voice", "eau ")], "rule string, term string")
    return WO.lint_prompts(t.documents, terms)


@query("b22_missing_vocabulary", "SELECT term, count(*) FILTER (NOT contains(coalesce(text, ''), term)) AS n_missing FROM documents, (VALUES ('the'), ('eau '), ('$')) AS t(term) GROUP BY 1")
def _(t: Tables):
    return WO.missing_vocabulary(t.documents, t.spark.createDataFrame([("the",), ("eau ",), ("$",)], "term string"))


_FORMATS = ['{"label": 0, "confidence": 1}', '{"confidence": 1, "label": 0}', '{"label": 0}', '{"label": 0, "confidence": 1, "evidence": []}']


@query("b22_key_order", "SELECT error, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 = 2 THEN 'missing key' WHEN o_orderkey % 4 = 1 THEN 'other order' WHEN o_custkey % 2 = 0 THEN 'other first key' END AS error FROM orders) GROUP BY 1")
def _(t: Tables):
    specs = t.orders.select(F.element_at(F.array(*map(F.lit, _FORMATS)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("output_format"), F.array(F.lit("label"), F.lit("confidence")).alias("key_order"), F.when(F.col("o_custkey") % 2 == 0, "evidence").otherwise("label").alias("first_key"))
    return WO.key_order_errors(specs).groupBy("error").agg(F.count("*").alias("n"))


@query("b22_voices_crossed", "SELECT count(DISTINCT voices) <= 1 AS crossed FROM (SELECT o_orderpriority, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS voices FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 5 GROUP BY 1)")
def _(t: Tables):
    from ..operators.resample import first_n_per_class

    first = first_n_per_class(t.orders, "o_orderpriority", "o_orderkey", 5)
    return WO.voices_crossed(first.select(F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("voice")))


@query("b22_drift", "SELECT drift, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'gone' WHEN c_custkey % 7 = 0 THEN 'changed' END AS drift FROM customer UNION ALL SELECT 'new' FROM supplier) WHERE drift IS NOT NULL GROUP BY 1")
def _(t: Tables):
    old = t.customer.select("c_custkey", F.col("c_name").alias("text"))
    new = old.where("c_custkey % 10 <> 0").withColumn("text", F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(F.col("text"))).unionByName(t.supplier.select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("text")))
    return WO.drift(old, new, "c_custkey", "text").groupBy("drift").agg(F.count("*").alias("n"))


@query("b23_feature_source", "SELECT source, count(*) AS n, count(*) FILTER (cell_idx < 8) AS named FROM citations JOIN (VALUES ('architecture', 'epithelium'), ('serration', 'epithelium')) AS s(feature, source) USING (feature) GROUP BY 1", ("citations",))
def _(t: Tables):
    sources = t.spark.createDataFrame([("architecture", "epithelium"), ("serration", "epithelium")], "feature string, source string")
    return WO.feature_source(t.citations, sources).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("cell_idx") < 8).alias("named"))


@query("b24_cache_key", "SELECT image_id, sha256('{\"image_id\":' || image_id || ',\"label\":\"' || label || '\"}') AS cache_key FROM annotations", ("annotations",))
def _(t: Tables):
    return t.annotations.select("image_id", SC.cache_key(label=F.col("label"), image_id=F.col("image_id")).alias("cache_key"))


@query("c6_pending", "SELECT c_custkey AS image_id, experiment FROM customer, (SELECT DISTINCT experiment FROM calls) WHERE (c_custkey, experiment) NOT IN (SELECT (image_id, experiment) FROM calls WHERE NOT failed AND predicted_label IS NOT NULL)", ("calls",))
def _(t: Tables):
    jobs = L.enumerate_jobs(t.customer.select(F.col("c_custkey").alias("image_id")), [t.calls.select("experiment").distinct()]).drop("replicate")
    return L.pending(jobs, t.calls, ["image_id", "experiment"], "no_error_and_parsed").select("image_id", "experiment")


@query("c7_cache_lookup", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN image_id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 'written' WHEN image_id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3) THEN 'hit' ELSE 'miss' END AS status FROM annotations) GROUP BY 1", ("annotations",))
def _(t: Tables):
    of = lambda n: t.lineitem.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("image_id"))
    return L.cache_lookup(t.annotations, of(3), of(7), "image_id").groupBy("status").agg(F.count("*").alias("n"))


@query("c8_enumerate_jobs", "SELECT arm, replicate, count(*) AS n FROM annotations, (VALUES ('a'), ('b')) AS d(arm), range(1, 4) AS r(replicate) WHERE replicate = 1 OR image_id % 5 = 0 GROUP BY ALL", ("annotations",))
def _(t: Tables):
    dim = t.spark.createDataFrame([("a",), ("b",)], "arm string")
    jobs = L.enumerate_jobs(t.annotations.select("image_id"), [dim], 3, F.col("image_id") % 5 == 0)
    return jobs.groupBy("arm", F.col("replicate").cast("long").alias("replicate")).agg(F.count("*").alias("n"))


_OK = "predicted_label IS NOT NULL AND NOT failed"
_COST = f"""SELECT experiment, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, (sum(input_tokens) * 2.5::DOUBLE + sum(output_tokens) * 10.0::DOUBLE) / 1e6 AS cost,
    sum(latency_seconds) AS runtime_seconds, count(DISTINCT CASE WHEN {_OK} THEN image_id END) AS completed, count(DISTINCT CASE WHEN {_OK} THEN image_id END) / 150.0::DOUBLE AS coverage FROM calls GROUP BY 1"""


def _costs(t: Tables):
    return L.cost_ledger(t.calls, "experiment", 2.5, 10.0, 150)


@query("d30_cost_ledger", _COST, ("calls",), ("cost", "runtime_seconds", "coverage"))
def _(t: Tables):
    return _costs(t)


@query("d31_budget", f"""
    SELECT *, 20 - cost AS remaining, CASE WHEN mean_full_cost > 0 THEN floor(greatest(20 - cost, 0) / mean_full_cost)::BIGINT END AS affordable_runs, 20 - cost < 0 AS over_budget FROM (
        SELECT sum(calls)::BIGINT AS calls, sum(cost) AS cost, avg(cost) FILTER (coverage >= 0.95) AS mean_full_cost FROM ({_COST}))""", ("calls",), ("cost", "mean_full_cost", "remaining"))
def _(t: Tables):
    return L.budget_projection(_costs(t), 20.0)


@query("d32_local_costs", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), 0) AS seconds FROM lineitem", (), ("seconds",))
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", L.first_nonzero("l_discount", "l_tax").alias("seconds"))


@query("d18_run_health", f"SELECT experiment, count(*) AS records, count(*) FILTER ({_OK}) AS scored, count(*) FILTER (failed) AS errors, count(*) FILTER (NOT failed AND predicted_label IS NULL) AS parse_failures FROM calls GROUP BY 1", ("calls",))
def _(t: Tables):
    return L.run_health(t.calls, "experiment")


@query("d18_match_gap", f"SELECT experiment, count(*) AS records, count(*) FILTER ({_OK}) AS scored, coalesce(avg(latency_seconds) FILTER ({_OK} AND seq % 2 = 0), 0) AS mean_match_gap FROM calls GROUP BY 1", ("calls",), ("mean_match_gap",))
def _(t: Tables):
    """The gap counts in one arm alone, here that of even numbers."""
    return L.run_health(t.calls, "experiment", F.when(F.col("seq") % 2 == 0, F.col("latency_seconds"))).select("experiment", "records", "scored", "mean_match_gap")


@query("d35_completion_audit", f"""
    WITH p AS (SELECT experiment, image_id, count(*) FILTER ({_OK}) AS s, count(*) FILTER (NOT ({_OK})) AS f FROM calls GROUP BY ALL)
    SELECT experiment, sum(s)::BIGINT AS success_rows, count(*) FILTER (s > 0) AS unique_ids, (sum(s) - count(*) FILTER (s > 0))::BIGINT AS duplicates, 150 - count(*) FILTER (s > 0) AS remaining,
           sum(f)::BIGINT AS failures, count(*) FILTER (f > 0 AND s > 0) AS recovered_ids FROM p GROUP BY 1""", ("calls",))
def _(t: Tables):
    return L.completion_audit(t.calls, "experiment", 150)


@query("j7_quarantine", f"SELECT seq, experiment, failed FROM calls WHERE NOT ({_OK})", ("calls",))
def _(t: Tables):
    return L.quarantine(t.calls)[1].select("seq", "experiment", "failed")


@query("j1_score_batch", "SELECT label, count(*) AS n, count(*) FILTER (image_id % 17 = 0) AS errors FROM annotations GROUP BY 1", ("annotations",))
def _(t: Tables):
    def scorer(prompt: str) -> str:
        label, number = prompt.split("|")
        if int(number) % 17 == 0:
            raise ValueError("refused")
        return label

    rows = t.annotations.select(F.col("image_id").cast("string").alias("cache_key"), F.concat_ws("|", "label", F.col("image_id").cast("string")).alias("prompt"), "label")
    scored = SC.score_batch(rows, scorer)
    return scored.join(rows.select("cache_key", "label"), "cache_key").groupBy("label").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


@query("j1_score_run", """
    WITH r AS (SELECT *, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS k FROM customer), a AS (SELECT *, k <= 50 AS first, c_custkey % 17 = 0 AS bad FROM r)
    SELECT 1 AS run, false AS cache_hit, bad AS failed, count(*) AS n FROM a WHERE first GROUP BY ALL UNION ALL SELECT 2, first AND NOT bad, bad, count(*) FROM a GROUP BY ALL""")
def _(t: Tables):
    """The first run may call 50 times, the second one calls what is left; failures are called again."""
    def scorer(prompt: str) -> str:
        if int(prompt) % 17 == 0:
            raise ValueError("refused")
        return prompt

    rows = t.customer.select(F.col("c_custkey").cast("string").alias("cache_key"), F.col("c_custkey").cast("string").alias("prompt"))
    cache, ledger = fresh_folder(t.spark, "cache"), fresh_folder(t.spark, "ledger")
    runs = [SC.score_run(rows, scorer, cache, ledger, most).withColumn("run", F.lit(i)) for i, most in ((1, 50), (2, None))]
    return runs[0].unionByName(runs[1]).groupBy("run", "cache_hit", F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


@query("j6_probe_evaluate", """
    WITH r AS (SELECT l_orderkey % 2 AS label, l_quantity / 50::DOUBLE AS p FROM lineitem), c AS (SELECT p AS s, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM r GROUP BY 1),
    z AS (SELECT *, coalesce(sum(b) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT (SELECT avg((label = (p >= 0.5)::INT)::INT::DOUBLE) FROM r) AS accuracy, (SELECT sum(a * (below + b / 2.0::DOUBLE))::DOUBLE / (sum(a) * sum(b))::DOUBLE FROM z) AS roc_auc,
           (SELECT avg(-ln(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-15))) FROM r) AS loss, (SELECT count(*) FROM r) AS n""", (), ("accuracy", "roc_auc", "loss"))
def _(t: Tables):
    p = F.col("l_quantity") / F.lit(50.0)
    rows = t.lineitem.select((F.col("l_orderkey") % 2).alias("label"), (p >= 0.5).cast("int").alias("predicted"), p.alias("p_positive"))
    return SC.probe_evaluate(rows.withColumn("p_true", F.when(F.col("label") == 1, F.col("p_positive")).otherwise(1 - F.col("p_positive"))))


_MEANS = "SELECT label, list(m ORDER BY i) AS mean_vector FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL) GROUP BY 1"


@query("j2_zero_shot", f"""
    WITH c AS ({_MEANS}), s AS (SELECT vec_id, c.label AS class, list_sum([embedding[k]::DOUBLE * mean_vector[k] FOR k IN range(1, 65)]) * 10 AS logit FROM embeddings e CROSS JOIN c)
    SELECT vec_id, class AS predicted, p AS confidence FROM (
        SELECT vec_id, class, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, class) AS k FROM s WINDOW w AS (PARTITION BY vec_id)) WHERE k = 1""", (), ("confidence",))
def _(t: Tables):
    classes = SC.mean_vectors(t.embeddings, "label", "embedding").select(F.col("label").alias("class"), F.col("mean_vector").alias("class_vector"))
    return SC.argmax_class(SC.zero_shot(t.embeddings.select("vec_id", "embedding"), classes, "vec_id", 10.0), "vec_id")


@query("j4_pool_tokens", """
    WITH e AS (SELECT vec_id // 10 AS item, vec_id % 10 AS token, embedding FROM embeddings),
    m AS (SELECT item, i, avg(x) AS m FROM (SELECT item, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM e WHERE token > 0) GROUP BY ALL)
    SELECT item, h[1]::DOUBLE AS first, s AS mean_sum FROM (SELECT item, embedding AS h FROM e WHERE token = 0) JOIN (SELECT item, sum(m) AS s FROM m GROUP BY 1) USING (item)""", (), ("first", "mean_sum"))
def _(t: Tables):
    tokens = t.embeddings.select(F.expr("vec_id DIV 10").alias("item"), (F.col("vec_id") % 10).alias("token"), "embedding")
    pooled = SC.pool_tokens(tokens, "item", "token", "embedding")
    rest = F.aggregate(F.slice("pooled", 65, 64), F.lit(0.0), lambda s, x: s + x)
    return pooled.select("item", F.element_at("pooled", 1).alias("first"), rest.alias("mean_sum"))


@query("j3_extract_embeddings", "SELECT doc_id % 10 AS bucket, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def _(t: Tables):
    def make():
        return lambda texts: [[float(len(x)), 1.0] for x in texts]

    vectors = SC.extract_embeddings(t.documents, make, "doc_id", "text", 2)
    return vectors.groupBy((F.col("doc_id") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.element_at("embedding", 1)).cast("long").alias("chars"))


@query("j5_linear_probe")
def _(t: Tables):
    from ..operators.metrics import log_loss

    train, test = t.embeddings.where("vec_id % 4 <> 0"), t.embeddings.where("vec_id % 4 = 0")
    scores = SC.probe_scores(SC.linear_probe(train, "embedding", "label", rounds=10), test, "embedding", "label", "vec_id")
    accuracy = scores.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return log_loss(scores, F.col("p_true")).crossJoin(accuracy)


def _calls_stream(t: Tables):
    events = ST.table_stream(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema)
    return t.spark.sql(fixtures.VIEWS["calls"].replace("FROM events", "FROM {source}"), source=events)


def _final(t: Tables, stream, mode: str, name: str):
    """Run a stream to the end of its input; its last state as a table."""
    path = fresh_folder(t.spark, name)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/{number:06d}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return path


@query("k1_ingest_calls", f"SELECT 'good' AS route, count(*) AS n FROM calls WHERE {_OK} UNION ALL SELECT 'quarantine', count(*) FROM calls WHERE NOT ({_OK})", ("calls",))
def _(t: Tables):
    good, bad = fresh_folder(t.spark, "good"), fresh_folder(t.spark, "bad")
    ST.ingest_calls(_calls_stream(t), good, bad, fresh_folder(t.spark, "ingest")).awaitTermination()
    count = lambda p, name: t.spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(name).alias("route"), "n")
    return count(good, "good").unionByName(count(bad, "quarantine"))


@query("k2_stream_dedup", f"SELECT DISTINCT experiment, image_id FROM calls WHERE {_OK}", ("calls",))
def _(t: Tables):
    path = _final(t, ST.stream_dedup(_calls_stream(t), ["experiment", "image_id"]), "append", "dedup")
    return t.spark.read.option("recursiveFileLookup", True).parquet(path).select("experiment", "image_id")


@query("k3_running_cost", f"SELECT experiment, count(*) AS calls, count(DISTINCT image_id) FILTER ({_OK}) AS answered, (sum(input_tokens) * 2.5::DOUBLE + sum(output_tokens) * 10.0::DOUBLE) / 1e6 AS cost, (sum(input_tokens) * 2.5 + sum(output_tokens) * 10.0) / 1e6 > 5 AS over_budget FROM calls GROUP BY 1", ("calls",), ("cost",))
def _(t: Tables):
    """Every third call is delivered twice, and items are answered again and again: calls and items count once."""
    again = F.explode(F.array_repeat(F.lit(1), F.when(F.col("seq") % 3 == 0, 2).otherwise(1)))
    calls = _calls_stream(t).withColumn("delivery", again)
    path = _final(t, ST.running_cost(calls, "seq", "image_id"), "update", "cost")
    parts = t.spark.read.option("recursiveFileLookup", True).parquet(path)
    return ST.total_cost(parts, 2.5, 10.0, 5.0)
