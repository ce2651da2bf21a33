"""A corpus from `documents`: five stages, each over all that the one before kept.

Every stage but the last returns the columns of documents. Empty input gives
empty output. Texts that are null or without a letter are near no language, so
the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, packing, simhash, suffix_dedup
from tidemark.llm.common import col, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a passage that may stand once only: some 45 words, so that passages of 50 words and more are found.
PASSAGE_BYTES = 250


def _shaped(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars true to the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predicts each document's language, which becomes its lang; documents too far from every language go."""
    found = langid.predict(docs, langid.fit(docs))
    return _shaped(found.filter(~F.col("rejected")).withColumn("lang", F.col("lang_pred")))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that at least ten documents share."""
    return _shaped(line_dedup.line_dedup(docs, "text", min_docs=10))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8 or more."""
    return _shaped(simhash.one_per_group(docs, "text", "doc_id", shingle=5, similarity=0.8))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every string of PASSAGE_BYTES that also stands elsewhere."""
    return _shaped(suffix_dedup.without_repeats(docs, "text", PASSAGE_BYTES))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents, by their words, into sequences of the permitted lengths."""
    return packing.best_fit_packing(docs, packing.word_count("text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", shared_lines),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", sequences),
]

#: Language ID, fingerprints and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[col(c) for c in COLUMNS])
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
