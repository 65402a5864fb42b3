"""Cut documents into chunks.

A document is one row, so each chunker works inside the row: texts are never
shuffled, and chunks of a document come out in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.functions.text import let, strip, words

SENTENCE_BREAK = r"""(?U)(?<=[.!?])[\s\x1c-\x1f]+(?=[A-Z"'(])"""


def chunk_id(document: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", document.cast("string"), index)


def chunk_fixed(
    docs: DataFrame, size: int = 512, overlap: int = 64, min_len: int = 20, link_kept: bool = False
) -> DataFrame:
    """Windows of ``size`` words that step by ``size - overlap``; shorter than ``min_len`` characters are dropped.

    ``next_chunk`` names the following window even when that one is dropped as
    too short; ``link_kept=True`` links kept chunks only.
    """
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    if min_len > size:
        raise ValueError("min_len cannot exceed size")

    def windows(all_words: Column) -> Column:
        total = F.size(all_words)
        starts = F.sequence(F.lit(0), F.greatest(total, F.lit(1)) - 1, F.lit(size - overlap))
        return F.transform(
            starts,
            lambda s: F.struct(
                F.array_join(F.slice(all_words, s + 1, size), " ").alias("text"),
                F.least(F.lit(size), total - s).alias("word_count"),
                (s + size < total).alias("more"),
            ),
        )

    kept = F.filter(let(words(F.col("text")), windows), lambda w: F.length(w.text) >= min_len)
    windowed = docs.select("document_id", kept.alias("kept")).withColumn("n_kept", F.size("kept"))
    indexed = explode_once(windowed, F.col("kept"), "c", "chunk_index")
    index = F.col("chunk_index")
    has_next = index < F.col("n_kept") - 1 if link_kept else F.col("c.more")
    return indexed.select(
        chunk_id(F.col("document_id"), index).alias("chunk_id"),
        "document_id",
        "chunk_index",
        F.lit("").alias("section"),
        F.lit("").alias("heading"),
        F.col("c.text").alias("text"),
        F.col("c.word_count").alias("word_count"),
        F.floor(F.col("c.word_count") * 1.3).cast("int").alias("token_count"),
        F.when(index > 0, chunk_id(F.col("document_id"), index - 1)).otherwise("").alias("previous_chunk"),
        F.when(has_next, chunk_id(F.col("document_id"), index + 1)).otherwise("").alias("next_chunk"),
    )


def _plain_chunks(pieces: DataFrame) -> DataFrame:
    """Chunks out of (document_id, pieces array<struct<section, heading, text>>), numbered in order."""
    exploded = explode_once(pieces, F.col("pieces"), "p", "chunk_index")
    n_words = F.size(words(F.col("p.text")))
    return exploded.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "chunk_index",
        F.col("p.section").alias("section"),
        F.col("p.heading").alias("heading"),
        F.col("p.text").alias("text"),
        n_words.alias("word_count"),
        n_words.alias("token_count"),
        F.lit("").alias("previous_chunk"),
        F.lit("").alias("next_chunk"),
    )


def chunk_sentences(docs: DataFrame, min_len: int = 20) -> DataFrame:
    """One chunk per sentence; a sentence ends at ``. ! ?`` before a capital, quote or bracket."""
    kept = F.filter(F.split(strip(F.col("text")), SENTENCE_BREAK), lambda s: F.length(s) >= min_len)
    return _plain_chunks(
        docs.select(
            "document_id",
            F.transform(
                kept, lambda s: F.struct(F.lit("").alias("section"), F.lit("").alias("heading"), s.alias("text"))
            ).alias("pieces"),
        )
    )


def chunk_sections(docs: DataFrame, min_len: int = 20) -> DataFrame:
    """One chunk per section of ``docs.sections``; the whole text when no section is long enough."""

    def piece(section, heading, text):
        return F.struct(section.alias("section"), heading.alias("heading"), strip(text).alias("text"))

    kept = F.filter("sections", lambda s: F.length(strip(s.content)) >= min_len)
    whole_heading = F.when(F.size("sections") > 0, F.lit("")).otherwise(F.lit("Body"))
    pieces = F.when(
        F.size(kept) > 0, F.transform(kept, lambda s: piece(s.heading, s.heading, s.content))
    ).otherwise(F.array(piece(F.lit("Body"), whole_heading, F.col("text"))))
    return _plain_chunks(docs.select("document_id", pieces.alias("pieces")))


_CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "fixed": chunk_fixed,
    "sentence": chunk_sentences,
    "section": chunk_sections,
}


def register_chunker(name: str, chunker: Callable[..., DataFrame]) -> None:
    _CHUNKERS[name] = chunker


def chunk(docs: DataFrame, strategy: str = "fixed", **options) -> DataFrame:
    if strategy not in _CHUNKERS:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return _CHUNKERS[strategy](docs, **options)


def document_stats(chunks: DataFrame) -> DataFrame:
    """Totals per document; list columns are counted when the chunks carry them."""

    def listed(name: str) -> Column:
        sized = F.size(name) if name in chunks.columns else F.lit(0)
        return F.sum(sized).cast("long").alias(f"total_{name}")

    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.sum("token_count").cast("long").alias("total_tokens"),
        F.sum("word_count").cast("long").alias("total_words"),
        listed("tables"),
        listed("figures"),
        listed("citations"),
    )
