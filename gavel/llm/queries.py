"""One query for each operator, over its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gavel.llm import (ann, html_extract, language_id, line_dedup, manifest, mixing, packing, quality,
                       simhash_dedup, substring_dedup, url_filter, vector_dedup, whitening)
from gavel.llm.common import is_small, table

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the query, fixed values.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
             ("org/fr/", "allow")]


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_copies(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = language_id.held_out()
    dictionaries = language_id.fit_dictionaries(documents.where(~held_out))
    found = language_id.identify_language(documents.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "lost_chars", "kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_text(pages, html_extract.fit_extractor(pages))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"),
                        "block", "order_key")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(text: Column) -> Column:
        return manifest.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)

    # Where five divides a document's number, what is checked has its capitals changed.
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", digest(F.col("text")).alias("leaf"),
        F.when(changed, digest(lower)).alias("claimed"))
    built = manifest.build_manifest(docs, F.col("source"), F.col("doc_id"), F.col("leaf"))
    proven = manifest.prove(built).join(
        F.broadcast(built.groups.select("group", "subroot"))
        if is_small(built.groups) else built.groups.select("group", "subroot"), "group")
    root = manifest.folded(F.coalesce("row.claimed", "leaf"), F.col("proof"))
    return proven.select(
        "row.doc_id", "leaf", "subroot", F.lit(built.root).alias("root"),
        F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_simhash_dedup, op2_line_dedup, op3_best_fit_packing, op4_language_id,
    op5_nearest_vectors, op6_quality_rules, op7_html_extraction, op8_suffix_dedup, op9_url_filter, op10_mix_sources,
    op11_embedding_dedup, op12_merkle_manifest, op13_embedding_whitening)}
QUERIES["pipeline"] = corpus_pipeline.run
