"""A corpus pipeline of five stages over ``documents``.

toxicity: documents that score as toxic go. ngram_join: of documents linked by a similarity of 0.8 or more of their
5-word shingles, one row with the smallest id stays (null ids last; rows that repeat an id count as documents of their
own). suffix_dedup: bytes of 50-byte strings that an earlier document holds go from the texts (bytes
that are no longer part of a character go with them), and documents of which nothing is left. mixing: each
domain, language and source gives a seeded prefix of its documents by target weights, whole documents only.
packing: what is left becomes pieces of sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Its
result is written as Parquet and read again as the next one's docs. Rows with null text count as empty texts: the
stages keep them up to mixing, which takes no documents without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import mixing
from lacuna.llm.common import materialize, read
from lacuna.llm.ngram_join import ngram_components
from lacuna.llm.packing import pack
from lacuna.llm.suffix_dedup import remove_repeats
from lacuna.llm.toxicity import drop_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, ALIKE = 5, 80  #: words in a shingle, and hundredths of Jaccard similarity, that make near copies
SHARE = 0.8  #: of the tokens that reach the mixing stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read(spark, sf_dir, "labels")).select(*COLUMNS)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by id and text, as ids may repeat or be null; rows with equal ids and texts share a key
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found = ngram_components(docs.select(F.col("key").alias("doc_id"), "text"), n=SHINGLE, threshold=ALIKE)
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component_id"), F.count("set_id").alias("n"))
    found = materialize(found.join(docs.select("key", "doc_id").distinct(), "key"), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    stay = found.groupBy("component_id").agg(first.alias("first")).select("first.key")
    kept = docs.join(found.join(stay, "key", "left_anti").select("key"), "key", "left_anti")
    again = found.where("n > 1").select("key")
    once = kept.join(again, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(again, "key", "left_anti").select(*COLUMNS).unionByName(once)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = remove_repeats(docs, keep_text=True, carry=("lang", "source"))
    kept = kept.withColumnRenamed("kept_text", "text")
    kept = kept.where("n_bytes = 0 or text <> ''")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.with_domain(docs), mixing.query_weights(spark), SHARE)
    return mixed.where("take_tokens = n_tokens").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mix_sources),
    ("packing", packing),
]

#: None: the toxicity, join, suffix and packing stages have no SQL; tests/llm holds them against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
