"""A pipeline from raw documents to packed token sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrid.llm import langid, mixing, near, packing, suffix
from prosegrid.llm.queries import tokenizer_path, training_rows
from prosegrid.llm.scratch import Scratch
from prosegrid.session import ship

#: A document goes if no language reaches this probability.
LANGUAGE = 0.5
#: Nor if its n-grams are less likely than those of its language's texts by more standard deviations than this.
UNLIKE = 6.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Naive Bayes over character n-grams; texts that are in no language it knows, by their likelihood, go."""
    ship(spark)
    model = langid.fit(training_rows(docs))
    return langid.in_known_language(docs, model, LANGUAGE, norms=langid.norms(training_rows(docs), model), most=UNLIKE)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id stays."""
    return near.without_near_copies(docs, near.near_copies(docs))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut; documents that had nothing else go."""
    return suffix.without_repeats(docs, suffix.repeated_spans(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target weight asks."""
    return mixing.take(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024; one row for each piece of a document."""
    ship(spark)
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id").withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: No stage but the first rule of the language filter can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
