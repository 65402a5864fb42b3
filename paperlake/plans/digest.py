"""Topic digest of a period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.fixed_values import PERIOD_DAYS, TOPIC_QUERIES
from paperlake.operators.ranking import importance, trending
from paperlake.operators.tagging import enrich_items, topic_groups
from paperlake.session import cut_lineage
from paperlake.sources.search import topic_search


def in_period(articles: DataFrame, period: str, as_of) -> DataFrame:
    """Articles dated within the period's days up to ``as_of``."""
    day = F.lit(as_of).cast("date")
    return articles.where(
        F.col("publication_date").between(F.date_sub(day, PERIOD_DAYS[period]), day)
    )


def digest(
    articles: DataFrame,
    period: str,
    as_of,
    queries: Mapping[str, Sequence[str]] = TOPIC_QUERIES,
    limit: int | None = None,
    apply_period: bool = True,
    **dictionaries,
) -> dict[str, DataFrame]:
    """``items`` (tagged and scored), ``topics`` (grouped) and ``trending`` (best ten) of a period.

    An article found by two queries is listed for each, as a search returns it.
    With a ``limit`` only the first hits per query and source take part.
    """
    source = in_period(articles, period, as_of) if apply_period else articles
    found = topic_search(source, queries, limit)
    order = F.struct("query_id", "source", "seq")
    numbered = found.withColumn("article_seq", F.col("seq")).withColumn("seq", order)
    # read by three tables
    items = cut_lineage(importance(enrich_items(numbered, **dictionaries), as_of))
    return {"items": items, "topics": topic_groups(items), "trending": trending(items)}
