"""Retrieve chunks for a batch of questions and build their contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paperlake.operators.retrieval import embed, enrich_hits, rag_context, vector_search


def answer_contexts(
    questions: DataFrame,
    chunks: DataFrame,
    embeddings: DataFrame,
    k: int = 10,
    threshold: float = 0.0,
    embedder: str | None = "hashed_words",
    where=None,
) -> DataFrame:
    """Context, sources and confidence per (query_id, question).

    Questions are embedded unless they carry an embedding (``embedder=None``).
    """
    asked = questions if embedder is None else embed(questions, "question", embedder)
    hits = enrich_hits(vector_search(asked, embeddings, k, threshold, where=where), chunks)
    return rag_context(questions.select("query_id", "question"), hits)
