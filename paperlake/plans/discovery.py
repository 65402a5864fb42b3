"""Discover articles by six strategies, filter them, and describe authors and trends."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.fixed_values import (
    INSTITUTION_TERMS, INSTITUTIONS, LANDMARK_DOIS, MONITORED_TOPICS, TOPIC_QUERIES, TRACKED_JOURNALS, TREND_TERMS,
)
from paperlake.operators.authors import author_rank
from paperlake.operators.expansion import citation_expansion, reference_expansion
from paperlake.operators.quality import quality_filter
from paperlake.operators.trends import new_developments, topic_trends
from paperlake.session import cut_lineage
from paperlake.sources.search import institution_feed, journal_feed, term_search, topic_search

STRATEGIES = (
    "keyword_search", "citation_expansion", "reference_expansion", "author_tracking", "journal_tracking",
    "trend_detection",
)
ITEM = ("seq", "title", "authors", "journal", "doi", "pmid", "abstract", "source")


def union_strategies(found: Mapping[str, DataFrame]) -> DataFrame:
    """One frame with ``strategy``; ``seq`` becomes (strategy number, order within it)."""
    out = None
    for number, name in enumerate(STRATEGIES):
        if name not in found:
            continue
        part = found[name].select(
            *[F.col(c) for c in ITEM if c != "seq"],
            F.lit(name).alias("strategy"),
            F.struct(F.lit(number).alias("strategy_no"), F.col("order").alias("order"), F.col("seq").alias("seq")).alias("seq"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def discover(
    articles: DataFrame,
    edges: DataFrame,
    top: DataFrame,
    year: int,
    queries: Mapping[str, Sequence[str]] = TOPIC_QUERIES,
    seeds: Iterable[str] = LANDMARK_DOIS,
    institutions: Iterable[str] = INSTITUTIONS,
    institution_terms: Iterable[str] = INSTITUTION_TERMS,
    journals: Iterable[tuple[str, str, float]] = TRACKED_JOURNALS,
    topics: Mapping[str, str] = MONITORED_TOPICS,
    topic_terms: Iterable[str] = TREND_TERMS,
    limit: int | None = None,
    **patterns,
) -> dict[str, DataFrame]:
    """``items`` after the quality filter, with ``authors``, ``journals``, ``trends`` and ``developments``.

    ``articles`` are works (seq, work_id, title, abstract, affiliation, ...),
    ``edges`` their citations, ``top`` the ranked papers whose references to follow.
    With a ``limit`` each strategy takes its first articles per query, seed,
    paper, institution or journal only.
    """
    by_institution, tagged_authors = institution_feed(articles, institutions, institution_terms, limit)
    by_journal, journal_report = journal_feed(articles, journals, year, limit)
    by_topic = term_search(articles, {t: t for t in topics}, limit, must=topic_terms)
    found = {
        "keyword_search": topic_search(articles, queries, limit).withColumn("order", F.col("query_id")),
        "citation_expansion": citation_expansion(articles, edges, seeds, limit).withColumn("order", F.col("seed_doi")),
        "reference_expansion": reference_expansion(articles, edges, top, limit).withColumn(
            "order", F.col("citing_id").cast("string")
        ),
        "author_tracking": by_institution.withColumn("order", F.col("institution")),
        "journal_tracking": by_journal.withColumn("order", F.col("journal")),
        "trend_detection": by_topic.withColumn("order", F.col("query_id")),
    }
    # read by several tables below
    items = cut_lineage(quality_filter(union_strategies(found), **patterns))
    return {
        "items": items,
        "authors": author_rank(items),
        "tagged_authors": tagged_authors,
        "journals": journal_report,
        "trends": topic_trends(articles, year, topics),
        "developments": new_developments(items),
    }
