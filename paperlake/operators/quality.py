"""First-seen deduplication and quality flags of discovered articles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.fixed_values import CONFERENCE_PATTERNS, PREDATORY_PATTERNS, RETRACTION_WORDS
from paperlake.functions.text import contains_any, matches_any, strip, text_of


def first_seen(items: DataFrame) -> DataFrame:
    """Drop an item whose DOI came before, then one whose title came before among the rest.

    Both steps keep one row per key in each task before the shuffle. Items
    without a DOI get a key of their own, so they spread over all tasks.
    """
    has_doi = F.coalesce("doi", F.lit("")) != ""
    doi_key = F.when(has_doi, F.concat(F.lit("d"), F.col("doi"))).otherwise(F.concat(F.lit("s"), F.col("seq").cast("string")))
    title_key = F.md5(strip(F.lower(F.coalesce("title", F.lit("")))))

    def first(df: DataFrame, key) -> DataFrame:
        window = Window.partitionBy("_key").orderBy("seq")
        return df.withColumn("_key", key).withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_key", "_n")

    return first(first(items, doi_key), title_key)


def flag_quality(
    items: DataFrame,
    retracted: Iterable[str] = RETRACTION_WORDS,
    predatory: Iterable[str] = PREDATORY_PATTERNS,
    conference: Iterable[str] = CONFERENCE_PATTERNS,
    min_abstract: int = 50,
) -> DataFrame:
    """Add one flag per reason to reject an item, and the first ``reject_reason``."""
    text = text_of("title", "abstract")
    flagged = (
        items.withColumn("is_retracted", contains_any(text, retracted))
        .withColumn("is_predatory", matches_any(text_of("journal"), predatory))
        .withColumn("is_conference_abstract", matches_any(text, conference))
        .withColumn("is_low_quality", F.length(F.coalesce("abstract", F.lit(""))) < min_abstract)
    )
    reasons = ("retracted", "predatory", "conference_abstract", "low_quality")
    return flagged.withColumn(
        "reject_reason", F.coalesce(*[F.when(F.col(f"is_{r}"), F.lit(r)) for r in reasons])
    )


def quality_filter(items: DataFrame, **patterns) -> DataFrame:
    """First-seen items without a reason to reject them; a rejected item still counts as seen."""
    flagged = flag_quality(first_seen(items), **patterns)
    return flagged.where(F.col("reject_reason").isNull()).select(*items.columns)
