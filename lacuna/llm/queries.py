"""The registered queries of this subpackage: name -> callable(spark, sf_dir), and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontamination, manifest
from lacuna.llm.common import read
from lacuna.llm.fingerprints import document_fingerprints
from lacuna.llm.html_text import html_text
from lacuna.llm.licenses import license_scan
from lacuna.llm.licenses import oracle as license_oracle
from lacuna.llm import mixing
from lacuna.llm import negatives
from lacuna.llm.neighbours import divisible_queries, nearest_neighbours
from lacuna.llm.ngram_join import ngram_components
from lacuna.llm.packing import pack
from lacuna.llm.quality import quality
from lacuna.llm.suffix_dedup import remove_repeats
from lacuna.llm.toxicity import toxicity


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_domain(read(spark, sf_dir, "documents"))
    mixed = mixing.mix(docs, mixing.query_weights(spark), mixing.SHARE, max_epochs=mixing.EPOCHS)
    return mixed.select("doc_id", "domain", "lang", "source", F.col("epoch").cast("long").alias("epoch"), "n_tokens", "take_tokens")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents"), n=3, threshold=90)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, divisible_queries(vectors), k=20)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(*negatives.query_rows(read(spark, sf_dir, "embeddings")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read(spark, sf_dir, "documents"), manifest.without_breaks(F.col("doc_id"), F.col("text")))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_neighbours": op2_neighbours,
    "op3_html_text": op3_html_text,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_manifest": op12_manifest,
    "op13_decontamination": op13_decontamination,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": license_oracle(),
    "op6_mixing": mixing.oracle(),
    "op11_hard_negatives": negatives.oracle(),
    "op12_manifest": manifest.oracle(),
    "op13_decontamination": decontamination.oracle(),
}
