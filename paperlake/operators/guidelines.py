"""Guideline texts: sections, graded recommendations, citation checks and keyword search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.fixed_values import (
    CONTRAINDICATION, CONTRAINDICATION_PARTS, EVIDENCE_EN, EVIDENCE_EN_PARTS, EVIDENCE_RU, EVIDENCE_RU_PARTS, NOT_PLAIN,
    PREGNANCY, PREGNANCY_PARTS, STATEMENT_HINTS, STRENGTH_PARTS, STRENGTHS,
)
from paperlake.functions.rows import explode_once
from paperlake.functions.text import contains_any, labels_where, let, strip
from paperlake.sources.search import match_terms

def split_guidelines(texts: DataFrame) -> DataFrame:
    """(guideline_id, section_index, heading, content): blocks between blank lines, the first line is the heading."""
    split = F.split(strip(F.col("text")), "\n\n")
    blocks = explode_once(texts.select("guideline_id", "text"), split, "block", "section_index")
    lines = blocks.withColumn("lines", strip(F.col("block")))
    cut = F.instr("lines", "\n")
    return lines.select(
        "guideline_id",
        "section_index",
        F.substring_index("lines", "\n", 1).alias("heading"),
        F.when(cut > 0, F.substring(F.col("lines"), cut + 1, F.length("lines"))).otherwise(F.col("block")).alias("content"),
    )


def _holds(lowered: Column, parts: Sequence[str]) -> Column:
    """Whether all the parts occur; patterns run on such texts only."""
    return reduce(Column.__and__, [F.contains(lowered, F.lit(p)) for p in parts])


def _statements(text: Column, lowered: Column) -> Column:
    """All (strength, lang, text) of a text; a statement found twice keeps the first strength."""
    none = F.array().cast("array<struct<strength:string,lang:string,text:string>>")

    def matches(strength: str, lang: str, pattern: str) -> Column:
        texts = F.transform(F.regexp_extract_all(text, F.lit(f"(?iu){pattern}"), F.lit(1)), lambda t: strip(t))
        if strength == "conditional":
            texts = F.filter(texts, lambda t: ~contains_any(F.lower(t), NOT_PLAIN[lang]))
        return F.transform(
            texts,
            lambda t: F.struct(F.lit(strength).alias("strength"), F.lit(lang).alias("lang"), t.alias("text")),
        )

    # texts without any of these words hold no statement, whatever the pattern
    hint = reduce(Column.__or__, [F.contains(lowered, F.lit(h)) for h in STATEMENT_HINTS])
    found = [
        F.when(_holds(lowered, parts), matches(*rule)).otherwise(none) for rule, parts in zip(STRENGTHS, STRENGTH_PARTS)
    ]

    def once(every: Column) -> Column:
        return let(
            F.transform(every, lambda s: s.text),
            lambda texts: F.filter(every, lambda s, i: F.array_position(texts, s.text) == i + 1),
        )

    return F.when(hint, let(F.concat(*found), once)).otherwise(none)


def evidence_level(text: Column, lowered: Column) -> Column:
    def level(pattern: str, parts: Sequence[str]) -> Column:
        return F.when(_holds(lowered, parts), F.regexp_extract(text, pattern, 1)).otherwise("")

    found = let(
        level(EVIDENCE_RU, EVIDENCE_RU_PARTS),
        lambda ru: F.when(ru != "", ru).otherwise(level(EVIDENCE_EN, EVIDENCE_EN_PARTS)),
    )
    return let(found, lambda e: F.when(e != "", F.upper(e)).otherwise("expert_opinion"))


def pregnancy_class(text: Column, lowered: Column) -> Column:
    rules = zip(PREGNANCY, PREGNANCY_PARTS)
    return F.coalesce(
        *[F.when(_holds(lowered, parts) & text.rlike(p), F.lit(name)) for (name, p), parts in rules], F.lit("unknown")
    )


def _contraindications(text: Column, lowered: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(CONTRAINDICATION), F.lit(1)), lambda t: strip(t))
    some = reduce(Column.__or__, [F.contains(lowered, F.lit(p)) for p in CONTRAINDICATION_PARTS])
    return F.when(~some, F.array().cast("array<string>")).otherwise(found)


def _of_guidelines(df: DataFrame, guideline_ids: DataFrame) -> DataFrame:
    return df.join(guideline_ids.select("guideline_id").distinct(), "guideline_id", "left_semi")


def recommendations(sections: DataFrame, guideline_ids: DataFrame | None = None) -> DataFrame:
    """One row per recommendation of (guideline_id, section_index, heading, content).

    With ``guideline_ids`` only those of these guidelines; texts of others are not searched.
    """
    if guideline_ids is not None:
        sections = _of_guidelines(sections, guideline_ids)
    texts = sections.withColumn("_lowered", F.lower("content"))
    content, lowered = F.col("content"), F.col("_lowered")
    found = (
        texts.select(
            "guideline_id",
            "section_index",
            "heading",
            _statements(content, lowered).alias("statements"),
            evidence_level(content, lowered).alias("evidence_level"),
            _contraindications(content, lowered).alias("contraindications"),
            pregnancy_class(content, lowered).alias("pregnancy"),
        )
    )
    return (
        explode_once(found, F.col("statements"), "s", "position")
        .select(
            "guideline_id",
            "section_index",
            "position",
            F.col("s.text").alias("text"),
            F.col("s.lang").alias("lang"),
            F.col("s.strength").alias("strength"),
            "evidence_level",
            F.col("heading").alias("population"),
            "contraindications",
            "pregnancy",
            F.substring(F.sha2("s.text", 256), 1, 16).alias("text_hash"),
        )
    )


def register_texts(texts: DataFrame) -> DataFrame:
    """(source_id, text, seq) to one row per text hash; the last registration wins."""
    return texts.where(F.coalesce("text", F.lit("")) != "").groupBy(F.sha2("text", 256).alias("sha256")).agg(
        F.max_by("source_id", "seq").alias("source_id")
    )


def verify_citations(cited: DataFrame, registered: DataFrame) -> DataFrame:
    """``cited`` (with ``text``) plus verified, confidence and source_id, by exact text."""
    found = cited.withColumn("sha256", F.sha2("text", 256)).join(registered, "sha256", "left")
    hit = F.col("source_id").isNotNull()
    return found.withColumn("verified", hit).withColumn("confidence", F.when(hit, 1.0).otherwise(0.0))


def keyword_recommendations(
    questions: Mapping[str, str] | DataFrame, recs: DataFrame, guideline_ids: DataFrame | None = None
) -> DataFrame:
    """Recommendations that hold any word of a question, with the question's id; confidence 0.3.

    ``questions`` is a dictionary or, for batches of any size, a frame (question_id, question).
    """
    if guideline_ids is not None:
        recs = _of_guidelines(recs, guideline_ids)
    if isinstance(questions, DataFrame):
        words = F.split(strip(F.lower("question")), r"\s+")
        terms = explode_once(questions.select("question_id", "question"), words, "term").select("question_id", "term")
        found = match_terms(recs, terms, "text", "term").drop("term")
        key = ["question_id", "guideline_id", "section_index", "position"]
        once = found.repartition(*key).dropDuplicates(key)  # sorted after the exchange only
        return once.withColumn("confidence", F.lit(0.3))
    asked = let(
        F.lower("text"),
        lambda t: labels_where({q: contains_any(t, question.lower().split()) for q, question in questions.items()}),
    )
    return explode_once(recs, asked, "question_id").withColumn("confidence", F.lit(0.3))


def guideline_keyword_search(
    query: str, guidelines: DataFrame, sections: DataFrame, recs: DataFrame, k: int = 10
) -> DataFrame:
    """Guidelines scored 10 for the title, 5 per section and 3 per recommendation that hold the query."""
    query = query.lower()

    def points(df: DataFrame, column: str, each: int) -> DataFrame:
        hit = F.lower(F.coalesce(column, F.lit(""))).contains(query)
        return df.where(hit).groupBy("guideline_id").agg((F.count(F.lit(1)) * each).alias("points"))

    scored = (
        points(guidelines, "title", 10)
        .unionByName(points(sections, "content", 5))
        .unionByName(points(recs, "text", 3))
        .groupBy("guideline_id")
        .agg(F.sum("points").alias("score"))
    )
    return guidelines.join(scored, "guideline_id").orderBy(F.desc("score"), "seq").limit(k)


def search_guidelines(guidelines: DataFrame, hits: DataFrame) -> DataFrame:
    """Guidelines that own a chunk among the hits (query_id, document_id), once per query."""
    owners = hits.select("query_id", F.col("document_id").alias("guideline_id")).distinct()
    return guidelines.join(owners, "guideline_id")
