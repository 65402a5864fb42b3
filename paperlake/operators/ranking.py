"""Score and rank articles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.fixed_values import EVIDENCE_WEIGHTS, JOURNAL_TIERS, STUDY_WEIGHTS, TOPIC_WEIGHTS
from paperlake.functions.text import round_even


def _weight(value: Column, weights: Mapping[str, float], unknown: float) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(w)) for k, w in weights.items()], F.lit(unknown))


def importance(
    items: DataFrame,
    as_of,
    evidence: Mapping[str, float] = EVIDENCE_WEIGHTS,
    designs: Mapping[str, float] = STUDY_WEIGHTS,
    journals: Mapping[str, float] = JOURNAL_TIERS,
    topics: Mapping[str, float] = TOPIC_WEIGHTS,
    rounded: bool = True,
) -> DataFrame:
    """Add ``clinical_importance`` in 0..1 from evidence, design, journal, topics and age at ``as_of``."""
    has_evidence = F.coalesce("evidence_level", F.lit("")) != ""
    has_design = F.coalesce("study_design", F.lit("")) != ""
    journal = F.lower(F.coalesce("journal", F.lit("")))
    tier = F.coalesce(*[F.when(journal.contains(name), F.lit(w)) for name, w in journals.items()], F.lit(0.1))
    topic = F.greatest(
        F.lit(0.5),
        *[F.when(F.array_contains("topics", t), F.lit(w)).otherwise(0.5) for t, w in topics.items()],
    )
    days = F.datediff(F.lit(as_of).cast("date"), F.col("publication_date"))
    parts = [
        F.when(has_evidence, _weight(F.col("evidence_level"), evidence, 0.2) * 0.3).otherwise(0.1),
        F.when(has_design, _weight(F.col("study_design"), designs, 0.3) * 0.25).otherwise(0.05),
        tier * 0.2,
        topic * 0.15,
        F.when(
            F.col("publication_date").isNotNull(), F.greatest(F.lit(0.0), 1.0 - days / 365) * 0.1
        ).otherwise(0.02),
    ]
    total = F.lit(0.0)
    for part in parts:
        total = total + part
    score = F.least(F.lit(1.0), total)
    return items.withColumn("clinical_importance", round_even(score, 2) if rounded else score)


def rank_items(items: DataFrame, score: str = "clinical_importance") -> DataFrame:
    """Best first; input order breaks ties."""
    return items.orderBy(F.desc(score), "seq")


def trending(items: DataFrame, limit: int = 10, score: str = "clinical_importance") -> DataFrame:
    return rank_items(items, score).limit(limit)
