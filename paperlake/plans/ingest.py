"""Index documents, and ingest page texts, into the knowledge base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators.chunking import chunk
from paperlake.operators.parsing import parse_documents
from paperlake.operators.retrieval import embed
from paperlake.session import cut_lineage


def index_documents(
    docs: DataFrame, strategy: str = "fixed", embedder: str = "hashed_words", **options
) -> dict[str, DataFrame]:
    """(document_id, text, optional title) to ``documents``, ``chunks`` and ``embeddings`` frames.

    A document without text is kept with status "failed" and the error. Chunks are
    computed once and kept in the checkpoint folder, where all three frames read them.
    """
    good = docs.where(F.col("text").isNotNull())
    chunks = cut_lineage(chunk(good, strategy, **options))
    embeddings = embed(chunks.select("chunk_id", "document_id", "text"), "text", embedder).select(
        "chunk_id", "document_id", "embedding", F.lit(embedder).alias("model"), F.size("embedding").alias("dimensions")
    )
    totals = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.sum("token_count").cast("long").alias("total_tokens"),
        F.sum("word_count").cast("long").alias("total_words"),
    )
    title = F.col("title") if "title" in docs.columns else F.lit("")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    documents = (
        docs.select("document_id", title.alias("title"), F.col("text").isNull().alias("_failed"))
        .join(totals, "document_id", "left")
        .select(
            "document_id",
            "title",
            F.when(F.col("_failed"), "failed").otherwise("completed").alias("status"),
            F.when(F.col("_failed"), "document has no text").alias("error"),
            zero("total_chunks"),
            zero("total_tokens"),
            zero("total_words"),
            F.lit(embedder).alias("embedding_model"),
            F.lit(strategy).alias("chunking_strategy"),
            F.current_timestamp().alias("created_at"),
        )
    )
    return {"documents": documents, "chunks": chunks, "embeddings": embeddings}


def ingest_pages(pages: DataFrame, strategy: str = "section", **options) -> dict[str, DataFrame]:
    """Page rows (document_id, page_number, text, n_images) parsed and indexed; adds the ``parsed`` frame."""
    parsed = parse_documents(pages)
    docs = parsed.select("document_id", "title", "text", "sections")
    return {"parsed": parsed, **index_documents(docs, strategy, **options)}
