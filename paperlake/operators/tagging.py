"""Tag articles with topics, study designs and terms by keyword dictionaries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.fixed_values import (
    CLINICAL_TAGS, FALLBACK_TOPIC, STUDY_DESIGN_RULES, TOPIC_KEYWORDS, TOPIC_NAMES, TOPICS,
)
from paperlake.functions.text import contains_any, labels_where, let, text_of


def grouped_keywords(keywords: Mapping[str, str]) -> dict[str, list[str]]:
    """keyword -> label turned into label -> keywords, in first-use order."""
    groups: dict[str, list[str]] = {}
    for keyword, label in keywords.items():
        groups.setdefault(label, []).append(keyword)
    return groups


def dictionary_labels(text: Column, labels: Mapping[str, Iterable[str]], fold_keywords: bool = False) -> Column:
    """Labels with a keyword in ``text`` (already lower case), in dictionary order.

    A keyword with capitals never occurs in lower-cased text; ``fold_keywords`` lowers it first.
    """
    fold = (lambda k: k.lower()) if fold_keywords else (lambda k: k)
    return let(
        text, lambda t: labels_where({label: contains_any(t, map(fold, some)) for label, some in labels.items()})
    )


def tag_by_dictionary(
    df: DataFrame,
    labels: Mapping[str, Iterable[str]],
    columns: Sequence[str] = ("title", "abstract"),
    name: str = "label",
    fold_keywords: bool = False,
) -> DataFrame:
    """One row per row of ``df`` and label found in its text."""
    return explode_once(df, dictionary_labels(text_of(*columns), labels, fold_keywords), name)


def topics_of(
    text: Column,
    keywords: Mapping[str, str] = TOPIC_KEYWORDS,
    topics: Sequence[str] = TOPICS,
    fallback: str = FALLBACK_TOPIC,
) -> Column:
    """Sorted topics: by keyword, else by topic name in the text, else the fallback topic."""
    by_keyword = dictionary_labels(text, grouped_keywords(keywords))
    by_name = labels_where({t: text.contains(t.replace("_", " ")) for t in topics if t != fallback})
    return F.array_sort(
        F.when(F.size(by_keyword) > 0, by_keyword)
        .when(F.size(by_name) > 0, by_name)
        .otherwise(F.array(F.lit(fallback)))
    )


def assign_topics(items: DataFrame, **dictionaries) -> DataFrame:
    return items.withColumn("topics", topics_of(text_of("title", "abstract"), **dictionaries))


def study_design(text: Column, rules: Sequence[tuple[str, Iterable[str]]] = STUDY_DESIGN_RULES) -> Column:
    """The first design whose words occur in ``text`` (lower case), or null."""
    return F.coalesce(*[F.when(contains_any(text, words), F.lit(design)) for design, words in rules])


def tags_of(text: Column, design: Column, terms: Iterable[str] = CLINICAL_TAGS) -> Column:
    """Sorted distinct tags: the study design and the terms that occur."""
    named = F.when(design.isNotNull(), F.array(F.regexp_replace(design, "_", " "))).otherwise(
        F.array().cast("array<string>")
    )
    found = labels_where({term: text.contains(term) for term in terms})
    return F.array_sort(F.array_distinct(F.concat(named, found)))


def enrich_items(items: DataFrame, rules=STUDY_DESIGN_RULES, terms=CLINICAL_TAGS, **dictionaries) -> DataFrame:
    """Add ``topics``, ``study_design`` and ``tags``."""
    text = F.col("_text")
    return (
        items.withColumn("_text", text_of("title", "abstract"))
        .withColumn("topics", topics_of(text, **dictionaries))
        .withColumn("study_design", study_design(text, rules))
        .withColumn("tags", tags_of(text, F.col("study_design"), terms))
        .drop("_text")
    )


def topic_members(items: DataFrame, topics_col: str = "topics") -> DataFrame:
    """One row per item and topic."""
    return explode_once(items, F.col(topics_col), "topic")


def first_titles(members: DataFrame, keys: Sequence[str], n: int, name: str = "titles") -> DataFrame:
    """The first ``n`` titles per key as an array, in ``seq`` order."""
    window = Window.partitionBy(*keys).orderBy("seq")
    first = members.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n)
    titles = F.array_sort(F.collect_list(F.struct("_n", "title")))
    return first.groupBy(*keys).agg(F.transform(titles, lambda t: t.title).alias(name))


def topic_groups(items: DataFrame, names: Mapping[str, str] = TOPIC_NAMES, n_titles: int = 5) -> DataFrame:
    """Papers per topic with the first titles; the papers themselves are ``topic_members(items)``."""
    members = topic_members(items).select("topic", "seq", "title")
    counts = members.groupBy("topic").agg(F.count(F.lit(1)).alias("paper_count"), F.min("seq").alias("first_seq"))
    display = F.coalesce(*[F.when(F.col("topic") == t, F.lit(n)) for t, n in names.items()], F.col("topic"))
    return (
        counts.join(first_titles(members, ["topic"], n_titles), "topic")
        .withColumn("display_name", display)
        .withColumn("title_list", F.array_join(F.transform("titles", lambda t: F.concat(F.lit("- "), t)), "\n"))
    )
