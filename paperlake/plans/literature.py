"""Search all sources and merge what is the same work."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from paperlake.operators.identity import resolve_works
from paperlake.operators.merge import merge_works
from paperlake.sources.search import term_search, year_range


def search_works(
    articles: DataFrame,
    queries: Mapping[str, str],
    limit: int | None = None,
    source: str | None = None,
    from_year: int | None = None,
    to_year: int | None = None,
    threshold: float = 0.9,
    ratio: bool = True,
) -> DataFrame:
    """Works found by any of the queries in any source, merged; a ``limit`` counts per query and source."""
    found = term_search(year_range(articles, from_year, to_year), queries, limit, source)
    hits = found.drop("query_id", "rank").dropDuplicates(["seq"])
    return merge_works(resolve_works(hits, threshold, ratio=ratio))


def unify(articles: DataFrame, threshold: float = 0.9, fuzzy: bool = True, ratio: bool = True) -> DataFrame:
    """All articles resolved to works and merged."""
    return merge_works(resolve_works(articles, threshold, fuzzy, ratio=ratio))
