"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, chosen_path, conversation_trie, decontamination, ivfpq, language_crf, media, packing, secrets, sentencepiece_trie, toxicity_mil, wrapper
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: null or wordless texts are ``und``; see :func:`language_crf.language_of_documents`."""
    return language_crf.language_of_documents(table(spark, sf_dir, "documents"))


def op5_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: null or wordless texts score 0; see :func:`toxicity_mil.toxicity_of_documents`."""
    return toxicity_mil.toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payload of every document: a null text is empty, repeated rows are rows of their own; see :func:`media.document_media`."""
    return media.document_media(table(spark, sf_dir, "documents"))


def op1_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: null html is an empty text; see :func:`wrapper.extracted`."""
    return wrapper.extracted(table(spark, sf_dir, "pages"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score: null texts have none; see :func:`secrets.secrets_of_documents`."""
    return secrets.secrets_of_documents(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and back: a null text has none; see :func:`sentencepiece_trie.encoded`."""
    import public_tokenizers

    return sentencepiece_trie.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each of its participants; see :func:`chat.perspectives`."""
    return chat.perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", chat.mask_text(F.col("mask")))


def op8_ivfpq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one; unusable vectors take no part; see :func:`ivfpq.neighbours_of_every_hundredth`."""
    return ivfpq.neighbours_of_every_hundredth(table(spark, sf_dir, "embeddings"))


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; see :func:`chosen_path.joined`."""
    return chosen_path.joined(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document; a null text is the separator alone; see :func:`packing.packed_documents`."""
    import public_tokenizers

    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations; see :func:`conversation_trie.prefix_trie`."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document; see :func:`decontamination.hits_of_documents`."""
    return decontamination.hits_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers for every document; see :func:`alignment.alignment_of_documents`."""
    import public_tokenizers

    return alignment.alignment_of_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_wrapper_extraction": op1_wrapper_extraction,
    "op2_secret_forest": op2_secret_forest,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_crf": op4_language_crf,
    "op5_toxicity_mil": op5_toxicity_mil,
    "op6_media_columns": op6_media_columns,
    "op7_chat_perspectives": op7_chat_perspectives,
    "op8_ivfpq_neighbours": op8_ivfpq_neighbours,
    "op9_chosen_path_join": op9_chosen_path_join,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLES: dict[str, str] = {
    "op7_chat_perspectives": chat.PERSPECTIVES_SQL,
    "op11_prefix_trie": conversation_trie.TRIE_SQL,
    "op12_benchmark_decontamination": decontamination.HITS_SQL,
}
