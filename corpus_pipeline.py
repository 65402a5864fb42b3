"""A training corpus from ``documents``: clean, deduplicate, pseudonymise, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``. Every stage judges whole texts of all rows it is given.

Defined results: rows with a null doc_id are never merged with others; rows
repeated with the same doc_id become one in the second stage, of different texts
the smallest; null and empty texts fail the first stage; an empty table passes
through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm.mixing import mix_sources
from paperlake.llm.ngram_join import near_duplicates
from paperlake.llm.pseudonyms import pseudonymise
from paperlake.llm.quality_rules import judge_quality
from paperlake.llm.queries import MODEL, PSEUDONYM_KEY
from paperlake.llm.sentencepiece_model import encode
from paperlake.session import remove_folder, scratch_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_SHARE = 0.9  # of the tokens that reach the mixing stage


def _measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents`` with the given text and its length."""
    new = docs.withColumn("text", F.col(text))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that fail the base rules or lose too much text."""
    return _measured(judge_quality(docs.select(*COLUMNS)).where("kept"), "cleaned")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    docs = docs.select(*COLUMNS)
    first = near_duplicates(docs).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    kept = kept.select("doc_id", "row.*")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format."""
    return _measured(pseudonymise(docs.select(*COLUMNS), PSEUDONYM_KEY))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards tempered marginals of source, language and topic."""
    return mix_sources(docs.select(*COLUMNS), keep_share=KEEP_SHARE).where("sampled").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and their number."""
    found = encode(docs.select(*COLUMNS), public_tokenizers.path(MODEL))
    return found.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


STAGES = (
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
)

# Feistel pseudonyms, components of near duplicates and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with every stage's rows written to the shared folder."""
    folder = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}_{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:  # nothing reads it any more; what the last stage reads is left to the caller
                remove_folder(spark, before)
            before = path
    return docs
