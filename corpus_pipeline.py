"""The corpus pipeline: documents through operators of veridex.llm, stage by stage.

Each stage is written as Parquet in the shared folder and read again as the next one's documents. Language ID
drops documents without a language, near-dedup drops documents whose five-word shingles are at least 0.8 like
those of a kept one, decontamination drops documents that hold a benchmark window, the secret scan replaces
secrets in texts, and the last stage encodes what is left. Language ID learns from the labels of the documents that it is given.

Nulls: a document with null or empty text has no language and goes in the first stage; null labels, sources and sizes are
carried, rows with null doc_id pass (they are no near copies). Repeated rows: one stays; rows of one doc_id with other texts
are documents of their own. An empty table gives an empty result. Texts of any length are worked on whole. Extra columns are
carried through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import PATTERN, path

from veridex.llm import bpe, decontaminate, language, near_copies, secret_scan
from veridex.llm.store import written

RANKS = path("byte_bpe_multi_50k.tiktoken")
#: Bytes of texts that pass to a Python worker at once; several stages' workers share an executor.
BATCH_BYTES = 8 << 20


def _texts(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(_texts(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.first_of_each(_texts(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.uncontaminated(_texts(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(_texts(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(_texts(docs).select("doc_id", "text", "lang", "source", "n_chars"), RANKS, PATTERN, decoded=True)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: Language ID and the Markov models have no form in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
