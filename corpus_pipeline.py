"""Documents to token ids, in stages that each work on all that the one before left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.bpe import encoded, word_bpe
from scoreloom.llm.common import stored, table
from scoreloom.llm.mixing import mixed
from scoreloom.llm.ngram_join import one_of_each
from scoreloom.llm.quality import kept_documents
from scoreloom.llm.substring import cut_documents

# Near copies share 5-word shingles by 80 %; passages are cut from 50 words on, so that set phrases
# and short notices stay in place.
SHINGLE, PERCENT, PASSAGE = 5, 80, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, SHINGLE, PERCENT)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_documents(docs, PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian unsigned 32-bit numbers, one row per copy in the mix."""
    rows = encoded(docs.select("doc_id", "lang", "source", "text"), word_bpe())
    return rows.select("doc_id", "lang", "source", (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"), F.col("_ids").alias("ids"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", passages),
    ("source_mix", mix),
    ("bpe", tokens),
]

# SQL can't express the stages that group near copies, cut passages and encode; tests hold the rows
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
