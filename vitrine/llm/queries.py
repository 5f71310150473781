"""Registered queries of the operators in this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    class_model,
    decontamination,
    grid_join,
    language_id,
    licences,
    mixing,
    near_duplicates,
    prefix_trie,
    pseudonyms,
    repeats,
    structure_repair,
    toxicity,
    web_archives,
)
from .oracles import ORACLES
from .staging import crc_of_id, ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Key of the registered query; a deployment passes its own.
DEMO_KEY = "vitrine demonstration key"


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with validated personal values replaced by linked, format-preserving pseudonyms."""
    docs = table(spark, sf_dir, "documents")
    return pseudonyms.pseudonymise(docs, DEMO_KEY).select("doc_id", "text", "n_pii", F.array_join("pii_kinds", ",").alias("pii_kinds"))


@register
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with the exact shingle counts."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of similarity 0.85 and more."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), 0.85)


@register
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each document gives to the mix, and when."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs.select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken",
        F.round("position", 9).alias("position"), F.round("repeat_position", 9).alias("repeat_position"),
    )


@register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a lexicon learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id("doc_id", 4) == 2
    lexicon = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score_toxicity(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "n_hits")


@register
def op3_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives, in the order of the merged capture index."""
    index = web_archives.archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "timestamp", "intact")


@register
def op10_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of cosine 0.95 and more."""
    return grid_join.similar_vectors(table(spark, sf_dir, "embeddings"), 0.95)


@register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_of_id("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out).select("text", "lang"))
    return language_id.predict_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register
def op9_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a class bigram model of six sevenths of them."""
    return class_model.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), 7, 2)


@register
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that an earlier one has."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@register
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every common beginning of the rebuilt conversations with what sharing it saves."""
    nodes = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@register
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation, with its audit."""
    return structure_repair.repair_digest(table(spark, sf_dir, "conversations"))


@register
def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered templates of every document."""
    return licences.licence_digest(table(spark, sf_dir, "documents"))
