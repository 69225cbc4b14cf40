"""Registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, html_model, jaccard_join, kneser_ney, license_scan, lookup_clusters, mixing, pair_search, quality_rules,
               secret_scan, site_quality, suffix_dedup, warc_zip)
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the learned decision list's verdict on every document."""
    return quality_rules.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the bytes of 400-byte strings that start twice or more."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's epochs in a mix of 600 per thousand of the corpus's tokens."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")) \
        .select("doc_id", "domain", F.coalesce("lang", F.lit("unknown")).alias("language"),
                F.coalesce("source", F.lit("unknown")).alias("source"), "epoch", "n_tokens")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by the tree model."""
    pages = table(spark, sf_dir, "pages")
    return html_model.extract(pages, html_model.train(pages))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into ZIP archives, and every record read back by its range."""
    manifest = warc_zip.write_archives(table(spark, sf_dir, "pages"))
    return warc_zip.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words found in every document."""
    return decontaminate.score_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity and quality of every document, shrunk through source and language within source."""
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by way of a new ledger."""
    docs = table(spark, sf_dir, "documents")
    ledger, _ = secret_scan.scan(docs)
    return secret_scan.report(docs, ledger)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or that of the nearest directory above it."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that aren't held out; doubles rounded to 6 digits."""
    rows = kneser_ney.score_held_out(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_pair_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    index = pair_search.build_index(table(spark, sf_dir, "documents"))
    return pair_search.search(index, table(spark, sf_dir, "benchmark"))


def op13_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of every usable vector after three rounds."""
    return lookup_clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_suffix_dedup, op3_mix_sources, op4_html_extract, op5_ngram_jaccard, op6_warc_zip,
    op7_decontaminate, op8_site_quality, op9_secret_scan, op10_license_scan, op11_kneser_ney, op12_pair_search, op13_lookup_clusters)}
