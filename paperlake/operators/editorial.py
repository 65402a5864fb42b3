"""Top story, breaking findings, themes, conflicting findings and digest figures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.fixed_values import (
    BREAKING_WORDS, CONTRADICTION_PATTERNS, EMERGING_THEMES, HIGH_IMPACT_JOURNALS, NOVELTY_WORDS,
    OPPOSITE_DIRECTIONS, PRACTICE_WORDS, STORY_IMPORTANCE, STORY_JOURNAL, STORY_NOVELTY, STORY_PRACTICE, STORY_WORDS_MOST, THEMES,
)
from paperlake.functions.text import contains_any, count_hits, let, text_of
from paperlake.session import cut_lineage
from paperlake.operators.tagging import first_titles, tag_by_dictionary, topic_members

# --- top story ---------------------------------------------------------------


def with_story_score(
    papers: DataFrame,
    novelty: Iterable[str] = NOVELTY_WORDS,
    practice: Iterable[str] = PRACTICE_WORDS,
    journals: Iterable[str] = HIGH_IMPACT_JOURNALS,
) -> DataFrame:
    """Add ``story_score`` in 0..1: importance, novelty words, practice words and journal."""
    words = let(
        text_of("title", "abstract"),
        lambda t: F.least(F.lit(STORY_WORDS_MOST), count_hits(t, novelty) * STORY_NOVELTY)
        + F.least(F.lit(STORY_WORDS_MOST), count_hits(t, practice) * STORY_PRACTICE),
    )
    score = (
        F.coalesce("clinical_importance", F.lit(0.0)) * STORY_IMPORTANCE
        + words
        + F.when(contains_any(text_of("journal"), journals), STORY_JOURNAL).otherwise(0.0)
    )
    return papers.withColumn("story_score", F.least(F.lit(1.0), score))


def top_story(papers: DataFrame, minimum: float = 0.3, **dictionaries) -> DataFrame:
    """The paper with the best score, none when it stays below ``minimum``."""
    best = with_story_score(papers, **dictionaries).orderBy(F.desc("story_score"), "seq").limit(1)
    return best.where(F.col("story_score") >= minimum)


def breaking(
    papers: DataFrame, threshold: float = 0.6, words: Iterable[str] = BREAKING_WORDS, **dictionaries
) -> DataFrame:
    scored = with_story_score(papers, **dictionaries)
    urgent = contains_any(text_of("title", "abstract"), words)
    return scored.where((F.col("story_score") > threshold) | urgent)


# --- themes ------------------------------------------------------------------


def themes(
    papers: DataFrame,
    dictionary: Mapping[str, Iterable[str]] = THEMES,
    emerging: Iterable[str] = EMERGING_THEMES,
    fold_keywords: bool = False,
) -> DataFrame:
    """Papers per theme, momentum and the first three titles; largest theme first."""
    members = tag_by_dictionary(
        papers.select("seq", "title", "abstract"), dictionary, name="theme", fold_keywords=fold_keywords
    ).select("theme", "seq", "title")
    counts = members.groupBy("theme").agg(F.count(F.lit(1)).alias("paper_count"), F.min("seq").alias("first_seq"))
    momentum = F.when(F.col("theme").isin(*emerging) | (F.col("paper_count") <= 1), "emerging").otherwise("established")
    return (
        counts.join(first_titles(members, ["theme"], 3), "theme")
        .withColumn("momentum", momentum)
        .orderBy(F.desc("paper_count"), "first_seq", "theme")
    )


def merge_topics(papers: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` topics with more than one paper: lead authors of the first three papers, journals."""
    lead = F.coalesce(F.get("authors", F.lit(0)), F.lit("Unknown"))
    exploded = papers.select("seq", "journal", lead.alias("lead"), F.posexplode("topics").alias("position", "topic"))
    exploded = cut_lineage(exploded)  # the papers are read once, these narrow rows four times
    groups = (
        exploded.groupBy("topic")
        .agg(F.count(F.lit(1)).alias("paper_count"), F.min(F.struct("seq", "position")).alias("first_at"))
        .where("paper_count > 1")
        .orderBy("first_at")
        .limit(k)
    )
    chosen = exploded.join(F.broadcast(groups.select("topic")), "topic")  # k rows
    window = Window.partitionBy("topic").orderBy("seq")
    first = chosen.withColumn("_n", F.row_number().over(window)).where("_n <= 3")
    leads = first.groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "lead"))), lambda a: a.lead), "; ").alias(
            "lead_authors"
        )
    )
    journals = (
        chosen.where(F.coalesce("journal", F.lit("")) != "")
        .select("topic", "journal")
        .distinct()
        .groupBy("topic")
        .agg(F.array_join(F.array_sort(F.collect_list("journal")), ", ").alias("journals"))
    )
    return (
        groups.join(leads, "topic")
        .join(journals, "topic", "left")
        .withColumn("journals", F.coalesce("journals", F.lit("")))
        .orderBy("first_at")
    )


# --- conflicting findings ----------------------------------------------------


def conflict_signature(
    text: Column,
    patterns: Sequence[tuple[str, float]] = CONTRADICTION_PATTERNS,
    directions: Sequence[tuple[Iterable[str], Iterable[str]]] = OPPOSITE_DIRECTIONS,
) -> Column:
    """All a text contributes to a conflict score, as bits: one per pattern, then positive and negative words."""
    bits = [text.rlike(p) for p, _ in patterns]
    for positive, negative in directions:
        bits += [contains_any(text, positive), contains_any(text, negative)]
    signature = F.lit(0)
    for i, bit in enumerate(bits):
        signature = signature + F.when(bit, F.lit(1 << i)).otherwise(F.lit(0))
    return signature


def conflict_score(
    a: Column,
    b: Column,
    patterns: Sequence[tuple[str, float]] = CONTRADICTION_PATTERNS,
    n_directions: int = len(OPPOSITE_DIRECTIONS),
) -> Column:
    """Score of two papers from their signatures alone."""

    def has(signature: Column, i: int) -> Column:
        return signature.bitwiseAND(F.lit(1 << i)) != 0

    score = F.lit(0.0)
    for i, (_, weight) in enumerate(patterns):
        score = score + F.when(has(a, i) | has(b, i), weight).otherwise(0.0)
    for d in range(n_directions):
        positive, negative = len(patterns) + 2 * d, len(patterns) + 2 * d + 1
        opposed = (has(a, positive) & has(b, negative)) | (has(a, negative) & has(b, positive))
        score = score + F.when(opposed, 0.4).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def _signed(papers: DataFrame, patterns, directions) -> DataFrame:
    text = text_of("title", "abstract")
    signature = let(text, lambda t: conflict_signature(t, patterns, directions))
    return topic_members(papers.withColumn("signature", signature).drop("abstract"))


def _signature_pairs(signed: DataFrame, patterns, directions, minimum: float) -> DataFrame:
    """Conflicting signature pairs per topic. Their number is bounded by the bits, not by the papers."""
    counts = signed.groupBy("topic", "signature").agg(F.count(F.lit(1)).alias("n"))
    a = counts.select("topic", F.col("signature").alias("signature_a"), F.col("n").alias("n_a"))
    b = counts.select("topic", F.col("signature").alias("signature_b"), F.col("n").alias("n_b"))
    same = F.col("signature_a") == F.col("signature_b")
    return (
        a.join(b, "topic")
        .where("signature_a <= signature_b")
        .withColumn("score", conflict_score(F.col("signature_a"), F.col("signature_b"), patterns, len(directions)))
        .where(F.col("score") >= minimum)
        .withColumn(
            "n_pairs",
            F.when(same, (F.col("n_a") * (F.col("n_a") - 1) / 2).cast("long")).otherwise(F.col("n_a") * F.col("n_b")),
        )
        .where("n_pairs > 0")
    )


def controversy_groups(
    papers: DataFrame,
    patterns: Sequence[tuple[str, float]] = CONTRADICTION_PATTERNS,
    directions: Sequence[tuple[Iterable[str], Iterable[str]]] = OPPOSITE_DIRECTIONS,
    minimum: float = 0.5,
) -> DataFrame:
    """All conflicting pairs in compact form: per topic, pairs of signatures with their score and number of pairs."""
    return _signature_pairs(_signed(papers, patterns, directions), patterns, directions, minimum)


def controversial_papers(
    papers: DataFrame,
    patterns: Sequence[tuple[str, float]] = CONTRADICTION_PATTERNS,
    directions: Sequence[tuple[Iterable[str], Iterable[str]]] = OPPOSITE_DIRECTIONS,
    minimum: float = 0.5,
) -> DataFrame:
    """(topic, seq, n_conflicts, max_score) of each paper that conflicts with another one of the topic.

    A paper's partners are counted from its signature, so the cost is linear in the papers.
    """
    signed = _signed(papers.select("seq", "title", "abstract", "topics"), patterns, directions)
    pairs = _signature_pairs(signed, patterns, directions, minimum)
    same = F.col("signature_a") == F.col("signature_b")
    one = pairs.select(
        "topic",
        F.col("signature_a").alias("signature"),
        F.when(same, F.col("n_b") - 1).otherwise(F.col("n_b")).alias("partners"),
        "score",
    )
    other = pairs.where(~same).select(
        "topic", F.col("signature_b").alias("signature"), F.col("n_a").alias("partners"), "score"
    )
    per_signature = (
        one.unionByName(other)
        .groupBy("topic", "signature")
        .agg(F.sum("partners").alias("n_conflicts"), F.max("score").alias("max_score"))
    )
    return signed.select("topic", "signature", "seq").join(per_signature, ["topic", "signature"]).drop("signature")


def controversy_pairs(
    papers: DataFrame,
    k: int,
    patterns: Sequence[tuple[str, float]] = CONTRADICTION_PATTERNS,
    directions: Sequence[tuple[Iterable[str], Iterable[str]]] = OPPOSITE_DIRECTIONS,
    minimum: float = 0.5,
) -> DataFrame:
    """The ``k`` strongest conflicting pairs of each topic (topic, rank, score, seq_a, author_a, title_a, seq_b, author_b, title_b).

    Ordered by score, then by the papers' ``seq``. Pairs of signatures are taken from the strongest on, with their
    numbers of pairs, until k pairs are reached; only then are papers looked at, and of each signature only the first
    k + 1: a pair with a later one has k pairs before it, made with these. So no topic lists all its pairs.
    """
    lead = F.coalesce(F.get("authors", F.lit(0)), F.lit("Authors"))
    described = papers.select("seq", "title", "abstract", "topics", lead.alias("author"), F.col("title").alias("full_title"))
    signed = _signed(described, patterns, directions)
    # sums of the same weights in another order are the same score
    pairs = _signature_pairs(signed, patterns, directions, minimum).withColumn("score", F.round("score", 9))
    # all pairs of signatures of one score, so ties are settled by seq alone; their number is bounded by the bits
    levels = pairs.groupBy("topic", "score").agg(F.sum("n_pairs").alias("n"))
    stronger = Window.partitionBy("topic").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("before", F.coalesce(F.sum("n").over(stronger), F.lit(0))).where(F.col("before") < k)
    wanted = pairs.join(levels.select("topic", "score"), ["topic", "score"]).select("topic", "signature_a", "signature_b", "score")

    order = Window.partitionBy("topic", "signature").orderBy("seq")
    first = signed.select("topic", "signature", "seq", "author", "full_title").withColumn("place", F.row_number().over(order))
    first = first.where(F.col("place") <= k + 1)

    def side(letter: str) -> DataFrame:
        paper = F.struct("seq", "author", "full_title").alias(f"paper_{letter}")
        return first.select("topic", F.col("signature").alias(f"signature_{letter}"), paper)

    met = wanted.join(side("a"), ["topic", "signature_a"]).join(side("b"), ["topic", "signature_b"])
    once = (F.col("signature_a") != F.col("signature_b")) | (F.col("paper_a.seq") < F.col("paper_b.seq"))
    met = met.where(once).select("topic", "score", F.least("paper_a", "paper_b").alias("a"), F.greatest("paper_a", "paper_b").alias("b"))
    best = Window.partitionBy("topic").orderBy(F.desc("score"), "a.seq", "b.seq")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = [F.col(f"{x}.{c}").alias(f"{n}_{x}") for x in "ab" for c, n in (("seq", "seq"), ("author", "author"), ("full_title", "title"))]
    return ranked.select("topic", "rank", "score", *named)


def controversies(
    papers: DataFrame,
    patterns: Sequence[tuple[str, float]] = CONTRADICTION_PATTERNS,
    directions: Sequence[tuple[Iterable[str], Iterable[str]]] = OPPOSITE_DIRECTIONS,
    minimum: float = 0.5,
    title_chars: int | None = None,
) -> DataFrame:
    """One row per conflicting pair (topic, a before b, score), for digests a reader goes through.

    Only pairs that conflict are joined, but their number can grow with the
    square of a topic; over a whole corpus use ``controversy_groups`` or
    ``controversial_papers``, which hold the same findings in linear size.
    """
    lead = F.coalesce(F.get("authors", F.lit(0)), F.lit("Authors"))
    title = F.col("title") if title_chars is None else F.substring("title", 1, title_chars)
    described = papers.select(
        "seq", "title", "abstract", "topics", lead.alias("author"), title.alias("short_title")
    )
    signed = _signed(described, patterns, directions)
    pairs = _signature_pairs(signed, patterns, directions, minimum).select(
        "topic", "signature_a", "signature_b", "score"
    )

    def side(letter: str) -> DataFrame:
        return signed.select(
            "topic",
            F.col("signature").alias(f"signature_{letter}"),
            F.struct("seq", "author", "short_title").alias(f"paper_{letter}"),
        )

    joined = pairs.join(side("a"), ["topic", "signature_a"]).join(side("b"), ["topic", "signature_b"])
    distinct = joined.where(
        (F.col("signature_a") != F.col("signature_b")) | (F.col("paper_a.seq") < F.col("paper_b.seq"))
    )
    first = F.least("paper_a", "paper_b")
    second = F.greatest("paper_a", "paper_b")
    return distinct.select("topic", "score", first.alias("a"), second.alias("b")).select(
        "topic",
        "score",
        F.col("a.seq").alias("seq_a"),
        F.col("a.author").alias("author_a"),
        F.col("a.short_title").alias("title_a"),
        F.col("b.seq").alias("seq_b"),
        F.col("b.author").alias("author_b"),
        F.col("b.short_title").alias("title_b"),
    )


# --- figures of a digest -----------------------------------------------------


def editorial_digest(papers: DataFrame, practice_from: float = 0.6) -> DataFrame:
    """Figures of a digest as rows (section, position, seq, title, value).

    Sections: ``papers_reviewed``, ``high_evidence`` (levels A and B) and
    ``reading_minutes`` carry a value; ``most_important``, ``practice_changing``
    (the first five, with the count of all as value) and ``practice_impact``
    (levels A and B among the first three) carry papers.
    """
    high = F.col("evidence_level").isin("A", "B")
    changing = F.coalesce("clinical_importance", F.lit(0.0)) >= practice_from
    chars = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("abstract", F.lit("")))
    short = papers.select("seq", "title", "clinical_importance", "evidence_level", chars.alias("chars"))
    short = cut_lineage(short)  # the texts are read once, these narrow rows four times
    totals = short.agg(
        F.count(F.lit(1)).cast("double").alias("papers_reviewed"),
        F.count(F.when(high, 1)).cast("double").alias("high_evidence"),
        F.greatest(F.lit(1.0), F.rint(F.coalesce(F.sum("chars"), F.lit(0)) / 1500)).alias("reading_minutes"),
        F.count(F.when(changing, 1)).cast("double").alias("practice_changing_papers"),
    )
    figures = totals.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(c).alias("section"), F.col(c).alias("value")) for c in totals.columns]
            )
        ).alias("f")
    ).select(
        "f.section",
        F.lit(0).alias("position"),
        F.lit(None).cast(papers.schema["seq"].dataType).alias("seq"),
        F.lit(None).cast("string").alias("title"),
        "f.value",
    )

    def listed(section: str, rows: DataFrame, order: Sequence) -> DataFrame:
        window = Window.partitionBy("section").orderBy(*order)
        return rows.withColumn("section", F.lit(section)).select(
            "section",
            F.row_number().over(window).alias("position"),
            "seq",
            "title",
            F.col("clinical_importance").alias("value"),
        )

    best = [F.desc("clinical_importance"), F.asc("seq")]
    return (
        figures.unionByName(listed("most_important", short.orderBy(*best).limit(1), best))
        .unionByName(listed("practice_changing", short.where(changing).orderBy("seq").limit(5), ["seq"]))
        .unionByName(listed("practice_impact", short.orderBy("seq").limit(3).where(high), ["seq"]))
    )


def week_of(papers: DataFrame, first_day, days: int = 7) -> DataFrame:
    """The papers dated within ``days`` from ``first_day``, in the order of their daily digests; read in one scan."""
    first = F.lit(first_day).cast("date")
    day = F.date_diff("publication_date", first)
    inside = papers.where(day.between(0, days - 1))
    return inside.withColumn("seq", F.struct(day.alias("day"), F.col("seq").alias("seq")))


def weekly(dailies: Sequence[DataFrame]) -> DataFrame:
    """The papers of several daily digests, in digest order."""
    if not dailies:
        raise ValueError("a week needs at least one day")
    numbered = [d.withColumn("seq", F.struct(F.lit(i).alias("day"), F.col("seq").alias("seq"))) for i, d in enumerate(dailies)]
    out = numbered[0]
    for day in numbered[1:]:
        out = out.unionByName(day)
    return out
