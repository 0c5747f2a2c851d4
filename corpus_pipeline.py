"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes the documents that its predecessor kept and is written as Parquet and read again
before the next one; all but the last return the columns of documents. What a stage decides takes
effect: rejected documents, repeated lines, near copies and documents that the mix leaves out are
gone for the next, and documents that the mix takes twice are there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import bpe, language_id, line_dedup, mixing, near_dup
from codefacts.llm.common import table, written
from codefacts.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (``und``) are rejected; ``lang`` becomes the predicted one."""
    cols = docs.columns
    found = language_id.identify(docs.withColumn("__lang", F.col("lang")), language_id.learn(docs))
    kept = found.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).select(*[F.col(f"`{c}`") for c in cols])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` is that of the text that is left, and a document that lost
    all of its text goes with it."""
    left = line_dedup.drop_repeated_lines(docs)
    gone = (F.col("n_dropped") > 0) & (F.col("text") == "")
    kept = left.where(~F.coalesce(gone, F.lit(False)))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, shuffled within its shard."""
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the digests of the ids and of the bytes that they decode to."""
    found = bpe.digests("text", *vocabulary())
    return docs.select("doc_id", "lang", "source", found.alias("x")).select("doc_id", "lang", "source", "x.n_tokens", "x.ids_sha256", "x.decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: Language models, samplers and byte pairs are beyond SQL. The operators are held to brute force one by
#: one; the test of the pipeline holds what stages keep and return.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
