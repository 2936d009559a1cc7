"""The corpus pipeline: stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecut.llm.common import run_path, ship_path, written
from wavecut.llm.compact_windows import without_repeats
from wavecut.llm.encode import default_tokenizer
from wavecut.llm.langid import UNDETERMINED, default_vocabulary, held_out, train, with_language
from wavecut.llm.packing import pack_mixture
from wavecut.llm.simhash import keep_one_of_each
from wavecut.llm.templates import without_contaminated

#: A language is accepted from this posterior probability on.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    ship_path(spark)
    vocabulary = default_vocabulary()
    model = train(docs.where(~held_out()), vocabulary)
    found = with_language(docs, model, vocabulary, pred="_lang_pred", score="_lang_score")
    sure = (F.col("_lang_pred") != UNDETERMINED) & (F.col("_lang_score") >= LEAST_SCORE)
    return found.where(sure).drop("_lang_pred", "_lang_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: four-word shingles, fingerprints at most four bits apart."""
    ship_path(spark)
    return keep_one_of_each(docs, max_bits=4, width=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeated passage stays in its first document only."""
    ship_path(spark)
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_path(spark)
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with every source at its share."""
    ship_path(spark)
    return pack_mixture(docs, default_tokenizer())


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None  # fingerprints, fitted models and tokenizers have no counterpart in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each reads what the one before has written to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), run_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
