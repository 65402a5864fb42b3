"""Merge the records of a work into one article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import derive_id
from paperlake.sources.bibliographic import LISTS, SCALARS


def merge_works(articles: DataFrame) -> DataFrame:
    """One row per ``work_id``: first non-null scalars, ordered unions of lists, all sources, latest retrieval.

    Input order is ``seq``. Lists are reduced to distinct items per work before
    they are collected, so a work with very many records stays small.
    """
    scalars = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in SCALARS
    ]
    merged = articles.groupBy("work_id").agg(
        *scalars,
        *[F.min_by(c, "seq").alias(f"_first_{c}") for c in (*LISTS, "provenance")],
        F.max("retrieved_at").alias("retrieved_at"),
        F.count(F.lit(1)).alias("n_records"),
    )

    fields = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).alias("items")) for c in LISTS],
        F.struct(F.lit("provenance").alias("field"), F.array(F.col("source")).alias("items")),
    )
    items = (
        articles.select("work_id", "seq", F.explode(fields).alias("f"))
        .select("work_id", "seq", "f.field", F.posexplode("f.items").alias("position", "item"))
        .where((F.col("field") != "provenance") | (F.coalesce("item", F.lit("")) != ""))
        .groupBy("work_id", "field", "item")
        .agg(F.min(F.struct("seq", "position")).alias("at"))
    )

    def collected(name: str):
        entry = F.when(F.col("field") == name, F.struct("at", "item"))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["item"]).alias(f"_all_{name}")

    lists = items.groupBy("work_id").agg(*[collected(c) for c in (*LISTS, "provenance")])
    joined = merged.join(lists, "work_id", "left")
    none = F.array().cast("array<string>")

    def union(name: str):
        first = F.coalesce(f"_first_{name}", none)
        return F.concat(first, F.array_except(F.coalesce(f"_all_{name}", none), first)).alias(name)

    return joined.select(
        "work_id",
        derive_id(F.col("doi"), F.col("pmid"), F.col("pmcid"), F.col("title")).alias("article_id"),
        *SCALARS,
        *[union(c) for c in LISTS],
        union("provenance"),
        "retrieved_at",
        "n_records",
    )
