"""Topic growth and mentions of new procedures, devices, drugs, techniques and diseases."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.fixed_values import MONITORED_TOPICS, NOVELTY_KEYWORDS, NOVELTY_PATTERNS
from paperlake.functions.text import labels_where, let, text_of


def growth_labels(counts: DataFrame) -> DataFrame:
    """(topic, this_count, last_count) to growth, momentum and the emerging flag; topics without papers are dropped."""
    this, last = F.col("this_count"), F.col("last_count")
    growth = (this - last) / F.greatest(last, F.lit(1)) * 100
    return (
        counts.where((this > 0) | (last > 0))
        .withColumn("growth_rate", growth.cast("double"))
        .withColumn("paper_count", this + last)
        .withColumn("emerging", (F.col("growth_rate") > 50) & (this > 5))
        .withColumn(
            "momentum",
            F.when(F.col("growth_rate") > 100, "exploding").when(F.col("growth_rate") > 20, "growing").otherwise("stable"),
        )
    )


def _year_counts(tagged: DataFrame, year: int) -> DataFrame:
    both = tagged.where(F.col("year").isin(year, year - 1))
    return both.groupBy("topic").agg(
        F.count(F.when(F.col("year") == year, 1)).alias("this_count"),
        F.count(F.when(F.col("year") == year - 1, 1)).alias("last_count"),
    )


def topic_trends(articles: DataFrame, year: int, topics: Mapping[str, str] = MONITORED_TOPICS) -> DataFrame:
    """Growth of each monitored topic from ``year - 1`` to ``year``, fastest first."""
    text = text_of("title", "abstract")
    tagged = explode_once(articles, let(text, lambda t: labels_where({name: t.contains(name) for name in topics})), "topic").select("year", "topic")
    category = F.coalesce(*[F.when(F.col("topic") == t, F.lit(c)) for t, c in topics.items()])
    return (
        growth_labels(_year_counts(tagged, year))
        .withColumn("category", category)
        .orderBy(F.desc("growth_rate"), "topic")
    )


def label_trends(tagged: DataFrame, year: int) -> DataFrame:
    """Growth of labels that rows already carry in ``topic``."""
    return growth_labels(_year_counts(tagged, year)).orderBy(F.desc("growth_rate"), "topic")


def _matches(text: Column, patterns: Mapping[str, Iterable[str]], chars: int | None) -> Column:
    """Every match of every pattern in one array, so the texts are read once."""

    def matches(category: str, number: int, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(f"(?iU){pattern}"), F.lit(0)),
            lambda m, i: F.struct(
                F.lit(category).alias("category"),
                F.lit(number).alias("pattern"),
                i.alias("i"),
                (m if chars is None else F.substring(m, 1, chars)).alias("found"),
            ),
        )

    return F.concat(*[matches(c, n, p) for c, some in patterns.items() for n, p in enumerate(some)])


def new_developments(
    items: DataFrame,
    patterns: Mapping[str, Iterable[str]] = NOVELTY_PATTERNS,
    keywords: Mapping[str, Iterable[str]] = NOVELTY_KEYWORDS,
    limit: int | None = None,
    fold_keywords: bool = False,
    keyword_limit: int | None = None,
    chars: int | None = None,
) -> DataFrame:
    """(category, rank, found): the pattern matches per category, and the keywords that occur.

    ``limit`` keeps the first matches of a category, ``keyword_limit`` the first
    keywords by name, ``chars`` the first characters of a match.
    """
    raw = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    by_pattern = explode_once(items, _matches(raw, patterns, chars), "m").select("seq", "m")
    window = Window.partitionBy("m.category").orderBy("seq", "m.pattern", "m.i")
    first = by_pattern.withColumn("rank", F.row_number().over(window))
    first = first if limit is None else first.where(F.col("rank") <= limit)
    matched = first.select("m.category", "rank", F.trim(F.col("m.found")).alias("found"))

    text = text_of("title", "abstract")
    fold = (lambda k: k.lower()) if fold_keywords else (lambda k: k)
    names = [(category, k) for category, some in keywords.items() for k in some]
    pairs = let(text, lambda t: labels_where({f"{c}\t{k}": t.contains(fold(k)) for c, k in names}))
    named = (
        explode_once(items, pairs, "pair")
        .select("pair")
        .distinct()
        .select(F.split("pair", "\t")[0].alias("category"), F.split("pair", "\t")[1].alias("found"))
    )
    by_name = Window.partitionBy("category").orderBy("found")
    listed = named.withColumn("rank", F.row_number().over(by_name))
    listed = listed if keyword_limit is None else listed.where(F.col("rank") <= keyword_limit)
    return matched.unionByName(listed.select("category", "rank", "found"))
