"""Author, institution and co-author statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.fixed_values import AUTHOR_TOPICS
from paperlake.operators.tagging import dictionary_labels
from paperlake.session import is_small

LIST_BLOCK = 256  # authors of a list that meet as many others in one row


def _mentions(items: DataFrame) -> DataFrame:
    """One row per author of an item; an author listed twice counts twice."""
    return items.select("seq", "title", F.posexplode("authors").alias("position", "author")).where(
        F.coalesce("author", F.lit("")) != ""
    )


def author_counts(items: DataFrame) -> DataFrame:
    """Papers per author and where the author first appears, which breaks ties."""
    return (
        _mentions(items)
        .groupBy("author")
        .agg(F.count(F.lit(1)).alias("paper_count"), F.min(F.struct("seq", "position")).alias("first_at"))
    )


def author_papers(items: DataFrame, authors: DataFrame) -> DataFrame:
    """The papers of the given authors as rows, in order within an author."""
    wanted = authors.select("author").distinct()
    return _mentions(items).join(F.broadcast(wanted) if is_small(wanted) else wanted, "author").select("author", "seq", "title")


def author_rank(items: DataFrame, k: int = 20, topics: Mapping[str, Iterable[str]] = AUTHOR_TOPICS) -> DataFrame:
    """The ``k`` authors with most papers, with up to three topics found in their titles."""
    top = author_counts(items).orderBy(F.desc("paper_count"), "first_at").limit(k)
    titles = author_papers(items, top)  # k rows are broadcast
    found = (
        explode_once(titles, dictionary_labels(F.lower("title"), topics), "topic", "position")
        .groupBy("author", "topic")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "position")).alias("at"))
    )
    window = Window.partitionBy("author").orderBy(F.desc("n"), "at")
    best = found.withColumn("rank", F.row_number().over(window)).where("rank <= 3")
    listed = best.groupBy("author").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda t: t.topic).alias("top_topics")
    )
    return (
        top.join(listed, "author", "left")
        .withColumn("top_topics", F.coalesce("top_topics", F.array().cast("array<string>")))
        .orderBy(F.desc("paper_count"), "first_at")
    )


def emerging_authors(items: DataFrame, limit: int = 5, pool: int = 30, min_papers: int = 2) -> DataFrame:
    """Of the ``pool`` most active authors those with enough papers, the first ``limit``."""
    most = author_counts(items).orderBy(F.desc("paper_count"), "first_at").limit(pool)
    return most.where(F.col("paper_count") >= min_papers).orderBy(F.desc("paper_count"), "first_at").limit(limit)


def _top(df: DataFrame, column: str, k: int) -> DataFrame:
    named = df.where(F.coalesce(column, F.lit("")) != "")
    return (
        named.groupBy(column)
        .agg(F.count(F.lit(1)).alias("papers"), F.min("seq").alias("first_seq"))
        .orderBy(F.desc("papers"), "first_seq")
        .limit(k)
    )


def top_institutions(df: DataFrame, k: int = 10) -> DataFrame:
    return _top(df, "institution", k)


def top_countries(df: DataFrame, k: int = 10) -> DataFrame:
    return _top(df, "country", k)


def coauthor_edges(items: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """(src, dst, weight): ``src`` stands before ``dst`` in ``weight`` of the author lists.

    A list is cut into blocks of ``block`` authors, and each pair of blocks is a row of its own, so a list of many
    thousands of authors is spread over tasks and no row grows with its square.
    """
    named = F.filter("authors", lambda a: F.coalesce(a, F.lit("")) != "")
    once = F.array_distinct("names")
    simple = F.size("names") == F.size(once)
    # where each author first and last stands; the long way only for lists that name one twice
    plain = F.transform("names", lambda a, i: F.struct(a.alias("name"), i.alias("first"), i.alias("last")))
    back = F.reverse("names")
    place = lambda a: F.struct(
        a.alias("name"),
        (F.array_position("names", a) - 1).cast("int").alias("first"),
        (F.size("names") - F.array_position(back, a)).cast("int").alias("last"),
    )
    listed = items.select(named.alias("names")).where(F.size("names") > 1)
    listed = listed.select(simple.alias("simple"), F.when(simple, plain).otherwise(F.transform(once, place)).alias("e"))
    blocks = F.ceil(F.size("e") / block).cast("int")
    numbers = F.sequence(F.lit(0), blocks - 1)
    # without a repeated name nobody stands before those of an earlier block
    pairs = F.flatten(F.transform(numbers, lambda i: F.transform(
        F.filter(numbers, lambda j: (j >= i) | ~F.col("simple")), lambda j: F.struct(i.alias("i"), j.alias("j"))
    )))
    met = explode_once(listed, pairs, "p")
    part = lambda k: F.slice("e", F.col(f"p.{k}") * block + 1, F.lit(block))
    met = met.select(part("i").alias("left"), part("j").alias("right"))
    sources = explode_once(met, F.col("left"), "s").drop("left")
    later = F.transform(F.filter("right", lambda d: F.col("s.first") < d["last"]), lambda d: d["name"])
    edges = explode_once(sources.select(F.col("s.name").alias("src"), later.alias("later")), F.col("later"), "dst")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def collaborators(items: DataFrame, author: str) -> DataFrame:
    """Distinct authors that stand after ``author`` in some list; reads only lists that name the author."""
    position = F.array_position("authors", author).cast("int")
    return (
        items.where(F.array_contains("authors", author))
        .select(F.explode(F.slice("authors", position + 1, F.size("authors"))).alias("collaborator"))
        .where(F.coalesce("collaborator", F.lit("")) != "")
        .distinct()
    )
