"""A corpus-cleaning pipeline from five of the operators in ``weft.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; its result is written as Parquet
and read again before the next. The first four return the columns of ``documents``, the last one the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chosen_path, language_crf, packing, secrets, toxicity_mil
from weft.llm.common import table, written

#: Documents that score so much go.
TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts whose words are spelled like none of the learned languages."""
    seen = language_crf.with_language(docs, language_crf.trained(docs))
    kept = (F.col("_language.lang_pred") != language_crf.UNDETERMINED) & (F.col("_language.foreign") < language_crf.DEVIATIONS)
    return seen.where(kept).drop("_language")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents."""
    seen = toxicity_mil.with_toxicity(docs, toxicity_mil.trained(docs, table(spark, sf_dir, "labels")))
    return seen.where(F.col("_toxicity") < TOXIC).drop("_toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near duplicates."""
    return chosen_path.kept(docs, chosen_path.joined(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays, and n_chars follows its text."""
    dictionary = secrets.dictionary_of(docs)
    clean = secrets.redacted(docs, secrets.trained(secrets.example_findings(spark), dictionary), dictionary)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 4096 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("pack", pack)]
#: The stages hold trained models and a tokenizer; tests check them one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
