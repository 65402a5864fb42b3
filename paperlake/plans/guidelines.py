"""Ingest guideline texts and register their recommendations for citation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators.guidelines import recommendations, register_texts, split_guidelines


def ingest_guidelines(texts: DataFrame) -> dict[str, DataFrame]:
    """(guideline_id, title, text, seq) to ``guidelines``, ``sections``, ``recommendations`` and ``registered``."""
    sections = split_guidelines(texts)
    recs = recommendations(sections)
    # the last registration wins, so of texts that share an id the last one counts
    ordered = recs.join(texts.groupBy("guideline_id").agg(F.max("seq").alias("seq")), "guideline_id")
    registered = register_texts(
        ordered.select(
            F.col("guideline_id").alias("source_id"), "text", F.struct("seq", "section_index", "position").alias("seq")
        )
    )
    return {
        "guidelines": texts.select("guideline_id", "title", "seq"),
        "sections": sections,
        "recommendations": recs,
        "registered": registered,
    }
