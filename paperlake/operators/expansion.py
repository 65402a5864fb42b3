"""Follow citations: works that cite landmark papers, and references of top papers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.fixed_values import LANDMARK_DOIS
from paperlake.functions.text import canonical_doi
from paperlake.sources.search import ranked


def citation_expansion(
    works: DataFrame, edges: DataFrame, seeds: Iterable[str] = LANDMARK_DOIS, limit: int | None = None
) -> DataFrame:
    """The works citing each seed DOI; with a ``limit`` the first of each, with their rank.

    ``works`` holds (seq, work_id, doi, ...), ``edges`` (citing_id, cited_id).
    The seeds are few, so only edges of the seeds are shuffled.
    """
    spark = works.sparkSession
    wanted = spark.createDataFrame([(s,) for s in seeds], "seed_doi string").withColumn(
        "_doi", canonical_doi(F.col("seed_doi"))
    )
    seeded = works.withColumn("_doi", canonical_doi(F.col("doi"))).join(F.broadcast(wanted), "_doi").select(
        F.col("work_id").alias("cited_id"), "seed_doi"
    )
    citing = edges.join(seeded, "cited_id").select(F.col("citing_id").alias("work_id"), "seed_doi").distinct()
    found = citing.join(works, "work_id").withColumn("doi", canonical_doi(F.col("doi")))
    return ranked(found, ["seed_doi"], ["seq"], limit)


def reference_expansion(
    works: DataFrame, edges: DataFrame, top: DataFrame, per_paper: int | None = None
) -> DataFrame:
    """The references of each paper in ``top`` that has a DOI; the first ``per_paper`` of each if given.

    ``edges`` holds (citing_id, cited_id, position). ``top`` is a short ranked
    list; a reference without a record is skipped after the cut.
    """
    papers = top.where(F.coalesce("doi", F.lit("")) != "").select(F.col("work_id").alias("citing_id"))
    refs = edges.join(papers, "citing_id", "left_semi")
    first = ranked(refs, ["citing_id"], ["position"], per_paper)
    cited = works.withColumn("doi", canonical_doi(F.col("doi"))).withColumnRenamed("work_id", "cited_id")
    return first.join(cited, "cited_id")
