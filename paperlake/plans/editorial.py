"""Editorial view of a digest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from paperlake.operators.editorial import (
    breaking, controversial_papers, controversy_groups, editorial_digest, merge_topics, themes, top_story,
)


def editorial(
    papers: DataFrame,
    story: Mapping | None = None,
    theme_words: Mapping | None = None,
    conflicts: Mapping | None = None,
    breaking_words: Mapping | None = None,
) -> dict[str, DataFrame]:
    """All editorial tables of the papers of a period; the options replace the default dictionaries of their operators."""
    story, conflicts = dict(story or {}), dict(conflicts or {})
    return {
        "figures": editorial_digest(papers),
        "top_story": top_story(papers, **story),
        "breaking": breaking(papers, **{**story, **(breaking_words or {})}),
        "themes": themes(papers, **(theme_words or {})),
        "merged_topics": merge_topics(papers),
        "controversies": controversy_groups(papers, **conflicts),
        "controversial_papers": controversial_papers(papers, **conflicts),
    }
