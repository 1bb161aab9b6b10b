"""URL filters by host-suffix and path-prefix expressions.

Each url is expanded into expressions: every suffix of its host at a label boundary with every prefix of its
path that is as long as some rule's path. Expressions meet rules by equality of the first four bytes of their
SHA-256 digests; the full digest confirms, and of the rules that fit the longest wins (then the longer host).

Rules are broadcast only while their number is within a bound; beyond it the same equality is a shuffled join,
whose large partitions Spark splits. Urls with one host and like paths are judged once, and verdicts of hosts that
hold many urls go to these by broadcast (see heat).

Nulls: a null url, or one without "://", has empty host and path and fits no rule. Repeated rows are returned as
often as they occur; an empty rule table allows everything, an empty url table gives an empty result. Of other
columns only the key stays, so their names don't matter. Urls of any length are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .heat import attached, hot_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"
#: Rules up to this number (of at most 4 KB each) are broadcast.
BROADCAST_RULES = 10_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def indexed(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with their digests; a rule that is given twice counts once, block before allow."""
    clean = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), digest.alias("rule_digest"), _short(digest).alias("short")
    )


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(key, host, path, rule, verdict) for every url. rules: (host, path, verdict)."""
    index = indexed(rules)
    facts = index.agg(F.count("*"), F.collect_set("path_length"), F.max(F.length("rule"))).first()
    small = facts[0] <= BROADCAST_RULES and (facts[2] or 0) <= 4096
    parts = urls.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    lengths = F.array(*[F.lit(n) for n in sorted(facts[1])]) if facts[1] else F.array().cast("array<int>")
    # many urls share an expression, and expressions of one url differ: urls with one host and like prefixes are judged once
    longest = max(facts[1], default=0)
    stem = F.substring("path", 1, longest)
    counted = parts.groupBy("host", stem.alias("stem")).agg(F.count("*").alias("n"))
    stems = counted.select("host", "stem")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("stem")), lambda n: F.substr("stem", F.lit(1), n))
    expressions = stems.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    digest = _digest(F.col("suffix"), F.col("prefix"))
    expressions = expressions.select("host", "stem", digest.alias("digest"), _short(digest).alias("short"))
    index = index.drop("path_length")
    fits = expressions.join(F.broadcast(index) if small else index, "short").where("digest = rule_digest")
    best = fits.groupBy("host", "stem").agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "rule_verdict")).alias("best"))
    hot = hot_keys(counted, ["host", "stem"], urls.count())
    joined = attached(parts.withColumn("stem", stem), best, ["host", "stem"], hot)
    return joined.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
