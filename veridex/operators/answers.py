"""Semi-structured answers: finding the JSON in a raw response, and validating it leniently or strictly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_folder


@dataclass(frozen=True)
class Protocol:
    """Labels, features and keys that a dataset's answers may have."""

    labels: tuple[str, ...] = ("HP", "SSA")
    features: tuple[str, ...] = ("architecture", "serration", "stroma")
    keys: tuple[str, ...] = ("label", "confidence", "evidence")
    item_keys: tuple[str, ...] = ("feature", "grid_cells", "description")


def protocol_dim(spark: SparkSession, protocols: dict[str, Protocol]) -> DataFrame:
    """(dataset, labels, features): a broadcastable dimension."""
    return spark.createDataFrame([(n, list(p.labels), list(p.features)) for n, p in protocols.items()], "dataset string, labels array<string>, features array<string>")


def extract_json(raw: Column | str) -> Column:
    """struct(payload, error): the first balanced braces outside of strings, of the fenced part if there is a fence.

    One fold over runs of characters between braces, quotes and escapes decides; errors are "no opening brace" and "unbalanced braces".
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = F.coalesce(raw, F.lit(""))
    # a value as a lambda's variable is worked out once a row
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    body = once(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), lambda fenced: F.when(fenced != "", fenced).otherwise(text))
    rest = once(body, lambda b: F.when(b.contains("{"), F.substring(b, F.instr(b, "{"), F.length(b))))
    # runs of other characters, escaped pairs, and single marks; a pair outside of strings counts by its second character
    parts = lambda r: F.regexp_extract_all(r, F.lit(r'(?s)([^\\"{}]++|\\.|["{}\\])'), F.lit(1))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s, part):
        mark = F.when(s["quoted"], F.when(part == '"', part)).otherwise(F.substring(part, -1, 1))
        depth = s["depth"] + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        at = s["at"] + F.length(part)
        quoted = F.when(mark == '"', ~s["quoted"]).otherwise(s["quoted"])
        end = F.when((mark == "}") & (depth == 0), at).otherwise(0)
        moved = F.struct(depth.alias("depth"), quoted.alias("quoted"), at.alias("at"), end.alias("end"))
        return F.when(s["end"] > 0, s).otherwise(moved)

    def found(r, end):
        error = F.when(r.isNull(), "no opening brace").when(end == 0, "unbalanced braces")
        return F.struct(F.when(end > 0, F.substring(r, F.lit(1), end)).alias("payload"), error.alias("error"))

    return once(rest, lambda r: once(F.aggregate(parts(r), state, step, lambda s: s["end"]), lambda end: found(r, end)))


def key_order(payload: Column | str) -> Column:
    """Top-level keys as written."""
    return F.json_object_keys(payload)


def key_order_valid(df: DataFrame, payload: str, declared: str) -> DataFrame:
    """Whether the keys come in the declared order."""
    return df.withColumn("key_order_ok", F.coalesce(key_order(F.col(payload)) == F.col(declared), F.lit(False)))


def key_order_histogram(df: DataFrame, payload: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.array_join(key_order(F.col(payload)), ">"), F.lit("none")).alias("key_order")).agg(F.count("*").alias("n"))


def _kind(type_: str) -> Column:
    """object, array, string, number, boolean, null or missing, by a value's type. Booleans are no numbers."""
    t = F.col(type_)
    return (
        F.when(t.isNull(), "missing").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").otherwise("number")
    )


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


#: Read as this an object has its keys alone, in their order, and a value that is no object is null.
_NAMES = "map<string,struct<>>"


def validate(df: DataFrame, payload: str, protocol: Protocol, strict: bool = False) -> DataFrame:
    """df with parsed (label, confidence, evidence) and violations.

    Lenient: cells are trimmed and upper-cased, and split into valid and invalid; everything is recorded and no
    row goes. Strict: keys must be exactly the protocol's, and cells must be written as they are.
    """
    cell_ok = lambda c: F.coalesce(c.rlike("^[A-D][1-4]$"), F.lit(False))
    written = lambda x: F.coalesce(x["grid_cells"], F.array().cast("array<string>"))
    cells = written if strict else (lambda x: F.transform(written(x), lambda c: F.upper(F.trim(c))))
    bad = lambda x: F.filter(cells(x), lambda c: ~cell_ok(c))

    def item(x):
        return F.struct(x["feature"].alias("feature"), F.filter(cells(x), cell_ok).alias("grid_cells_valid"), bad(x).alias("grid_cells_invalid"), x["description"].alias("description"))

    # a step a level, so that an answer is parsed, and each part of it read, once. That the answer is an object and its evidence an
    # array shows as they are read as such; the type of a value is worked out from all that is in it
    v, array_of = F.col("_v"), "array<struct<feature:string,grid_cells:array<string>,description:string>>"
    df, columns = df.withColumn("_v", F.try_parse_json(payload)), df.columns
    df = df.withColumns({"_keys": F.map_keys(_get(v, "$", _NAMES)), "_conf_v": _get(v, "$.confidence", "variant"), "_items": _get(v, "$.evidence", array_of)})
    items_type = F.when(F.col("_items").isNotNull(), "ARRAY").otherwise(F.schema_of_variant(_get(v, "$.evidence", "variant")))
    df = df.withColumns({"_conf_type": F.schema_of_variant("_conf_v"), "_items_type": items_type, "_label": _get(v, "$.label", "string"), "_conf": _get(v, "$.confidence", "double")})
    df = df.withColumns({"_conf_kind": _kind("_conf_type"), "_items_kind": _kind("_items_type"), "_items": F.coalesce("_items", F.array().cast(array_of))})
    label, conf, conf_kind, items_kind, keys, items = (F.col(f"_{c}") for c in ("label", "conf", "conf_kind", "items_kind", "keys", "items"))
    whole = keys.isNotNull()
    parsed = F.when(whole, F.struct(label.alias("label"), F.when(conf_kind == "number", conf).alias("confidence"), F.transform(items, item).alias("evidence")))
    found = [
        F.when(~whole, "answer is no object"),
        F.when(whole & ~F.coalesce(label.isin(*protocol.labels), F.lit(False)), F.concat(F.lit("label "), F.coalesce(label, F.lit("missing")))),
        F.when(whole & (conf_kind != "number"), F.concat(F.lit("confidence "), conf_kind)),
        F.when((conf_kind == "number") & ~conf.between(0.0, 1.0), "confidence out of range"),
        F.when(whole & (items_kind != "array"), F.concat(F.lit("evidence "), items_kind)),
    ]
    per_item = F.flatten(F.transform(items, lambda x: F.array(
        F.when(~F.coalesce(x["feature"].isin(*protocol.features), F.lit(False)), F.concat(F.lit("feature "), F.coalesce(x["feature"], F.lit("missing")))),
        F.when(F.exists(cells(x), lambda c: ~cell_ok(c)), F.concat(F.lit("cells "), F.array_join(bad(x), ","))),
        F.when(F.size(written(x)) == 0, F.lit("cells none")),
        F.when(F.trim(F.coalesce(x["description"], F.lit(""))) == "", F.lit("description blank")),
    )))
    if strict:
        names = lambda allowed: F.array(*[F.lit(k) for k in sorted(allowed)])
        found.append(F.when(F.sort_array(keys) != names(protocol.keys), F.concat(F.lit("keys "), F.array_join(F.sort_array(keys), ","))))
        item_keys = _get(v, "$.evidence", f"array<{_NAMES}>")
        found.append(F.when(F.exists(item_keys, lambda k: ~F.coalesce(F.map_keys(k) == names(protocol.item_keys), F.lit(False))), "item keys"))
    return df.select(*columns, parsed.alias("parsed"), F.array_compact(F.concat(F.array(*found), per_item)).alias("violations"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine). The answers are validated once and kept in a table: as a filter, each rule would be worked out again."""
    path = fresh_folder(validated.sparkSession, "validated")
    validated.write.parquet(path)
    validated = validated.sparkSession.read.parquet(path)
    return validated.where(F.size("violations") == 0), validated.where(F.size("violations") > 0)


def stated(responses: DataFrame) -> DataFrame:
    """Responses (label_pred, confidence, evidence) as raw answers, for operators that parse."""
    items = F.transform("evidence", lambda x: F.struct(x["feature"].alias("feature"), x["grid_cells_valid"].alias("grid_cells"), x["description"].alias("description")))
    return responses.withColumn("raw", F.to_json(F.struct(F.col("label_pred").alias("label"), "confidence", items.alias("evidence"))))
