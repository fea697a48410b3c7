"""Corpus pipeline: language ID, near-duplicates, benchmark passages, secrets, byte-level BPE, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the first is given the documents.
All but the last return the columns of ``docs`` as they came, so extra columns pass through.

Defined results: documents without a letter (null texts too) go; those of unsure language (codewords as near, or no
labelled document to learn from) stay;
of each near-duplicate component one row stays; documents with a benchmark passage go; secrets are masked in the text;
the last stage gives the tokens of what is left. Empty tables stay empty; repeated rows are near-duplicates. What a stage
keeps is written once, since the next one reads it more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontaminate, language, near_dedup, secrets
from lattica.llm.common import table, written
from lattica.llm.queries import vocabulary

#: Learned models, training draws and hashed candidate search: no SQL states these rows; tests/llm holds brute force.
ORACLE_SQL: str | None = None


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have letters; documents of unsure language are kept as they are."""
    model = language.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column can clash with those of the prediction
    found = language.identify(plain, model, text=f"c{names.index('text')}")
    return found.where(F.col("lang_pred") != language.UND).select(plain.columns).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: that with the smallest id."""
    return near_dedup.distinct_documents(docs, k=5, num=80, den=100)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the base spans and the linked weak spans of every text; no document goes."""
    return secrets.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, decoded again."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", tell_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
