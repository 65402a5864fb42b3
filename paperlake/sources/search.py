"""Find articles by term, year, identifier, institution or journal."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.functions.terms import match_terms
from paperlake.functions.text import canonical_doi, contains_any, identity_key, labels_where, let, text_of


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence, limit: int | None) -> DataFrame:
    """The first ``limit`` rows per key with their rank; all rows, unranked, without a limit.

    Each task keeps its own first rows before the shuffle.
    """
    if limit is None:
        return df
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def split_terms(query: str) -> list[str]:
    return [term.strip().lower() for term in query.split(" OR ") if term.strip()]


def term_search(
    articles: DataFrame,
    queries: Mapping[str, str] | DataFrame,
    limit: int | None = None,
    source: str | None = None,
    must: Iterable[str] = (),
) -> DataFrame:
    """Articles whose title or abstract holds a term of a query, with ``query_id``.

    All of them, or with a ``limit`` the first per query and source, with ``rank``.
    ``must`` adds a second group of terms of which one has to occur too. A frame of
    (query_id, query) serves batches too large for literals.
    """
    text = text_of("title", "abstract")
    found = articles if source is None else articles.where(F.col("source") == source)
    must = list(must)
    if must:
        found = found.where(contains_any(text, must))
    if isinstance(queries, DataFrame):
        terms = explode_once(queries.select("query_id", "query"), F.split("query", " OR "), "term")
        terms = terms.select("query_id", F.trim("term").alias("term"))
        matched = match_terms(found.withColumn("_searched", text), terms, "_searched").drop("_searched", "term")
        once = matched.dropDuplicates(["query_id", "seq"])
        return ranked(once, ["query_id", "source"], ["seq"], limit)
    hits = let(text, lambda t: labels_where({name: contains_any(t, split_terms(q)) for name, q in queries.items()}))
    matched = explode_once(found, hits, "query_id")
    return ranked(matched, ["query_id", "source"], ["seq"], limit)


def topic_search(
    articles: DataFrame, topic_queries: Mapping[str, Sequence[str]], limit: int | None = None
) -> DataFrame:
    """``term_search`` for every query of each topic; ``topic`` tells which topic asked."""
    queries = {f"{topic}#{n}": query for topic, some in topic_queries.items() for n, query in enumerate(some)}
    return term_search(articles, queries, limit).withColumn("topic", F.split("query_id", "#")[0])


def year_range(articles: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Articles of the years ``lo``..``hi``, either side open."""
    if lo is not None:
        articles = articles.where(F.col("year") >= lo)
    if hi is not None:
        articles = articles.where(F.col("year") <= hi)
    return articles


def lookup(articles: DataFrame, identifiers: Iterable[str] | DataFrame) -> DataFrame:
    """The first article per identifier: ``/`` means DOI, ``PMC..`` PMCID, digits PMID, anything else a title term.

    ``identifiers`` is a list or, for batches of any size, a frame with a column ``identifier``.
    """
    if isinstance(identifiers, DataFrame):
        wanted = identifiers.select("identifier").distinct()
    else:
        rows = [(i,) for i in dict.fromkeys(identifiers)]
        wanted = articles.sparkSession.createDataFrame(rows, "identifier string")
    name = F.col("identifier")
    wanted = wanted.where(F.coalesce(name, F.lit("")) != "").withColumn(
        "_kind",
        F.when(F.contains(name, F.lit("/")), "doi")
        .when(F.upper(name).startswith("PMC"), "pmcid")
        .when(name.rlike("^[0-9]+$"), "pmid")
        .otherwise("title"),
    )
    as_key = (
        F.when(F.col("_kind") == "doi", canonical_doi(name))
        .when(F.col("_kind") == "pmcid", identity_key(name))
        .otherwise(name)
    )
    keys = F.array_compact(
        F.array(
            *[
                F.when(k.isNotNull(), F.struct(F.lit(kind).alias("_kind"), k.alias("_key")))
                for kind, k in (
                    ("doi", canonical_doi(F.col("doi"))), ("pmcid", identity_key(F.col("pmcid"))), ("pmid", F.col("pmid"))
                )
            ]
        )
    )
    held = explode_once(articles, keys, "_k").withColumns({"_kind": F.col("_k._kind"), "_key": F.col("_k._key")}).drop("_k")
    exact = wanted.where("_kind <> 'title'").withColumn("_key", as_key)
    by_key = held.join(exact, ["_kind", "_key"]).drop("_kind", "_key")
    terms = wanted.where("_kind = 'title'").drop("_kind")
    by_title = match_terms(articles.withColumn("_searched", F.col("title")), terms, "_searched", "identifier").drop("_searched")
    return ranked(by_key.unionByName(by_title), ["identifier"], ["seq"], 1).drop("rank")


def institution_feed(
    articles: DataFrame, institutions: Iterable[str] | DataFrame, terms: Iterable[str], limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(articles, authors tagged with the institution): one article per institution and DOI.

    ``institutions`` are names, or a frame with a column ``institution`` for any number of them. Articles without a DOI count as one DOI. With a ``limit`` only the first
    articles per institution and source are taken.
    """
    text = text_of("title", "abstract", "affiliation")
    searched = articles.drop("institution").where(contains_any(text, terms))
    if isinstance(institutions, DataFrame):
        named = institutions.select("institution").distinct()
        matched = match_terms(searched.withColumn("_searched", text), named, "_searched", "institution").drop("_searched")
    else:
        named = [i for i in dict.fromkeys(institutions) if i]
        hits = let(text, lambda t: labels_where({i: F.contains(t, F.lit(i.lower())) for i in named}))
        matched = explode_once(searched, hits, "institution")
    first = ranked(matched, ["institution", "source"], ["seq"], limit).drop("rank")
    once = ranked(
        first.withColumn("_doi", F.coalesce("doi", F.lit(""))), ["institution", "_doi"], ["seq"], 1
    ).drop("rank", "_doi")
    authors = once.select("institution", "seq", F.posexplode("authors").alias("position", "author"))
    return once, authors


def journal_feed(
    articles: DataFrame, journals: Iterable[tuple[str, str, float]], year: int, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(articles of the year of each tracked journal, one row per journal with how many there are).

    A ``limit`` cuts the feed to the first articles per journal; counts are of all.
    """
    known = articles.sparkSession.createDataFrame(
        [(i, *row) for i, row in enumerate(journals)],
        "position int, journal string, issn string, impact_factor double",
    )
    of_year = articles.where(F.col("year") == year)
    tracked = of_year.join(F.broadcast(known.select("journal")), "journal", "left_semi")
    feed = ranked(tracked, ["journal"], ["seq"], limit).drop("rank")
    counts = tracked.groupBy("journal").agg(F.count(F.lit(1)).alias("papers"))
    report = known.join(counts, "journal", "left").select(
        "position",
        "journal",
        "issn",
        "impact_factor",
        F.coalesce("papers", F.lit(0)).cast("long").alias("papers_this_period"),
    )
    return feed, report
