"""Text of descriptions and prompts: keyword classes, criteria, rubric, tokens, rendering and linting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that place serration (class, label it speaks for), words of architecture, criterion patterns, stop words.
LOCATION = [
    ("upper", "upper_confined", "HP"), ("superficial", "upper_confined", "HP"), ("near the surface", "upper_confined", "HP"),
    ("deep into", "base_extending", "SSA"), ("deeper parts", "base_extending", "SSA"), ("extends deep", "base_extending", "SSA"),
    ("to the base", "base_extending", "SSA"), ("along the base", "base_extending", "SSA"),
    ("throughout the crypts", "throughout_implicit_base", "SSA"),
]
ARCHITECTURE = [
    ("straight", "orderly_narrow_bases", "HP"), ("parallel", "orderly_narrow_bases", "HP"), ("without the basal", "orderly_narrow_bases", "HP"),
    ("no basal", "orderly_narrow_bases", "HP"), ("lacking the basal", "orderly_narrow_bases", "HP"), ("do not show basal", "orderly_narrow_bases", "HP"),
    ("not show basal", "orderly_narrow_bases", "HP"),
    ("basal dilat", "basal_distortion", "SSA"), ("basal expansion", "basal_distortion", "SSA"), ("boot-shaped", "basal_distortion", "SSA"),
    ("l-shaped", "basal_distortion", "SSA"), ("horizontal", "basal_distortion", "SSA"), ("broadened base", "basal_distortion", "SSA"),
    ("flattened, broadened", "basal_distortion", "SSA"), ("distorted", "basal_distortion", "SSA"),
]
CRITERIA = [
    ("basal dilation", "basal (dilat|expansion)"), ("boot-shaped", "boot-shaped"), ("L-shaped", "l-shaped"), ("horizontal growth", "horizontal"), ("branching", "branch"),
]
STOP_WORDS = tuple((
    "the a an of in on at to and or is are with this that these those it its as show shows showing seen visible present within throughout across"
    " some few there their has have been be by from for which where while"
).split())

Rules = list[tuple[str, str, str]]


def first_match(text: Column | str, rules: Rules, otherwise: str) -> Column:
    """struct(kind, direction) of the first rule whose word the text holds, in any case; (otherwise, none) if none fits."""
    low = F.coalesce(F.lower(text), F.lit(""))
    pick = lambda at: F.coalesce(*[F.when(low.contains(r[0]), F.lit(r[at])) for r in rules], F.lit(("", otherwise, "none")[at]))
    return F.struct(pick(1).alias("kind"), pick(2).alias("direction"))


def classify_location(text: Column | str, rules: Rules = LOCATION) -> Column:
    return first_match(text, rules, "no_location")


def classify_architecture(text: Column | str, rules: Rules = ARCHITECTURE) -> Column:
    """HP words come first: phrases that deny a criterion name it too."""
    return first_match(text, rules, "generic")


def criterion_terms(text: Column | str, criteria: list[tuple[str, str]] = CRITERIA) -> Column:
    """The tags whose pattern the text matches."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(tag)) for tag, p in criteria]))


def content_tokens(text: Column | str, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case words of more than two letters a-z that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def rubric_relevance(items: DataFrame, rubric: DataFrame) -> DataFrame:
    """Items (feature, direction) with relevance and supported label; primary evidence without direction counts for nothing."""
    joined = items.join(F.broadcast(rubric), "feature", "left")
    undirected = F.col("direction") == "none"
    relevance = F.when((F.col("relevance") == "primary") & undirected, "none").otherwise(F.coalesce("relevance", F.lit("none")))
    support = F.when(~undirected, F.col("direction")).when(F.col("relevance") == "primary", F.lit("none")).otherwise(F.coalesce("supports", F.lit("none")))
    return joined.withColumns({"relevance": relevance, "support": support, "downgraded": F.coalesce((F.col("relevance") == "primary") & undirected, F.lit(False))}).drop("supports")


def description_report(items: DataFrame, by: list[str]) -> DataFrame:
    """Directional descriptions, those without direction (which count for nothing), and how often the former match the stated and the
    true label."""
    d = F.col("direction") != "none"
    return items.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(d).alias("directional"), F.count_if(~d).alias("downgraded"), F.count_if(d & (F.col("direction") == F.col("stated"))).alias("matches_stated"),
        F.count_if(d & (F.col("direction") == F.col("label"))).alias("matches_true"), F.sum(F.size("terms").cast("long")).alias("terms"),
    )


def class_counts(items: DataFrame, by: list[str]) -> DataFrame:
    """How many descriptions each class (kind) has."""
    return items.groupBy(*by, "kind").agg(F.count("*").alias("n"))


def inconsistent_items(items: DataFrame) -> DataFrame:
    """Descriptions with a direction that speaks for another label than the one stated."""
    return items.where((F.col("direction") != "none") & ~F.col("direction").eqNullSafe(F.col("stated")))


def feature_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Structure sources of cited features; features without one go. sources are few: items are not dealt out by feature."""
    return items.join(F.broadcast(sources), "feature")


def render_requests(items: DataFrame, blocks: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One request an item and prompt: the prompt's blocks (prompt_id, block_no, body) in order, joined."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "body"))), lambda x: x["body"])
    prompts = blocks.groupBy("prompt_id").agg(F.array_join(parts, separator).alias("prompt"))
    return items.crossJoin(F.broadcast(prompts)).withColumn("request_sha256", F.sha2(F.concat_ws("|", F.col("image_id").cast("string"), "prompt"), 256))


def lint_prompts(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """How many texts hold each term (term, rule), in any case."""
    hits = texts.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).join(F.broadcast(terms), F.col("low").contains(F.lower("term")))
    found = hits.groupBy("rule", "term").agg(F.count("*").alias("n_texts"))
    return terms.join(found, ["rule", "term"], "left").select("rule", "term", F.coalesce("n_texts", F.lit(0)).alias("n_texts"))


def missing_vocabulary(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """How many texts lack each term that they must hold, as written."""
    held = texts.select(F.coalesce(F.col(text), F.lit("")).alias("t")).crossJoin(F.broadcast(terms))
    return held.groupBy("term").agg(F.count_if(~F.col("t").contains(F.col("term"))).alias("n_missing"))


def key_order_errors(specs: DataFrame, output: str = "output_format", keys: str = "key_order", first: str = "first_key") -> DataFrame:
    """specs with what is wrong with the order of declared keys in their output format: a missing key, another order, another first key."""
    at = F.transform(F.col(keys), lambda k: F.position(F.concat(F.lit('"'), k, F.lit('"')), F.col(output)))
    error = F.when(F.exists(at, lambda p: p == 0), "missing key").when(at != F.array_sort(at), "other order").when(F.element_at(keys, 1) != F.col(first), "other first key")
    return specs.withColumn("error", error)


def voices_crossed(paraphrases: DataFrame) -> DataFrame:
    """(crossed): whether all conditions have the same voices in the same order. paraphrases: (condition, number, voice)."""
    voices = F.transform(F.array_sort(F.collect_list(F.struct("number", "voice"))), lambda x: x["voice"])
    each = paraphrases.groupBy("condition").agg(voices.alias("voices"))
    return each.agg((F.count_distinct("voices") <= 1).alias("crossed"))


def drift(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose frozen text changed, vanished or is new."""
    a = old.select(key, F.sha2(text, 256).alias("old_hash"))
    b = new.select(key, F.sha2(text, 256).alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return a.join(b, key, "full_outer").withColumn("drift", state).where("drift IS NOT NULL").select(key, "drift")
