"""A corpus from raw documents to packed sequences, in five written stages.

Language identification, exact and near deduplication and benchmark decontamination each keep
some of their documents, with all columns; packing returns the pieces of the sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longitab.llm import decontaminate, exact_dedup, language, near_dedup, packing
from longitab.llm.common import table
from longitab.llm.queries import vocabulary
from longitab.sources.shared import shared_folder


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is undetermined: null text, or no letter."""
    columns = docs.columns
    model = language.learn(docs.filter(language.in_training("doc_id")))
    found = language.identify(docs, model, with_spans=False).filter(F.col("lang_pred") != language.UNDETERMINED)
    return found.select(*[F.col(f"row.`{c}`") for c in columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    columns = docs.columns
    return exact_dedup.sort_dedup(docs, with_row=True).filter("kept").select(*[F.col(f"row.`{c}`") for c in columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.without_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item."""
    columns = docs.columns
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), with_row=True)
    return found.filter(~F.col("contaminated")).select(*[F.col(f"row.`{c}`") for c in columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences. Workers of the stages before still hold memory, so few parts are kept."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), kept_parts=200_000)


STAGES = [("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("decontamination", benchmark_stage), ("packing", packing_stage)]

#: Tokens and trained scores have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
