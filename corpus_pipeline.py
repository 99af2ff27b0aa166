"""Corpus pipeline: stages applied to the documents table one after another.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.  ``run`` writes each
stage's rows as Parquet in the shared folder and reads them again, so a lost
executor costs at most the stage at hand.

1. language ID: documents that no language explains go;
2. n-gram Jaccard join: of each group of near copies (five-word shingles,
   similarity 0.8 or more) the document with the smallest id stays;
3. substring dedup: words in windows of 20 words that also start earlier go;
4. benchmark decontamination: documents that hold half of a benchmark item go;
5. packing: the texts' ids, cut and packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.common import load, stored
from dagloom.llm.decontam import without_leaks
from dagloom.llm.jaccard import one_of_each
from dagloom.llm.langid import known_language_only
from dagloom.llm.packing import packed_digests
from dagloom.llm.substring import without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL has no tokenizer and no language model; tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language_only(docs, "pipeline-langid")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=5, num=80, den=100)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digests(docs, "pipeline-packing")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("substrings", substrings),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
