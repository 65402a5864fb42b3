"""Mixing sources to target weights (operator 4), in DataFrame operations only.

Documents are summed into cells of (source, language, topic). Iterative
proportional fitting rakes the token weights of cells until their sums by
source, by language and by topic meet the targets. A document is then sampled
with the probability of its cell, ``min(1, c · weight)``, where ``c`` makes the
expected tokens ``keep_share`` of all tokens. The draw is a hash of the id, so
it is the same on every run and machine.

Only cells are raked: they are aggregated in the tasks before any shuffle, so a
source with a third of all rows is no hot group. Targets are given per dimension
as {category: weight}; without them a category's target is its share of
tokens to the power ``temper``. Targets of categories without documents fall to
the others in proportion.

Defined results: a null source or language is the category "(none)"; a null or
empty text has 0 tokens, topic ``general`` if no topic's keyword occurs, and
still takes part; a null id is drawn like the id ""; repeated rows share one
draw; cells without tokens have weight 1; an empty table gives no rows; input columns
named like an added one are replaced, all others stay.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut_lineage, is_small

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
GENERAL = "general"
TOLD = 1e-4  # a share of all tokens by which a marginal may be off without a warning
WORD = r"[^\x20\x09-\x0D]+"
# Topics and their keywords, looked for anywhere in the lower-cased text.
TOPICS: dict[str, tuple[str, ...]] = {
    "legal": ("license", "licence", "copyright", "warranty", "liability", "jurisdiction"),
    "contact": ("@", "+1 (", "phone", "fax:", "e-mail"),
    "credentials": ("token", "password", "secret", "api key"),
}


def topic_of(text: Column, topics: Mapping[str, Sequence[str]] = TOPICS) -> Column:
    """The topic with most of its keywords in the text; the first of several, ``general`` if none occurs."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = {t: reduce(lambda a, b: a + b, (F.contains(lowered, F.lit(w)).cast("int") for w in ws)) for t, ws in topics.items()}
    best = F.greatest(*hits.values(), F.lit(0)) if hits else F.lit(0)
    chain = F.when(best == 0, GENERAL)
    for topic, n in hits.items():
        chain = chain.when(n == best, topic)
    return chain.otherwise(GENERAL)


def _targets(cells: DataFrame, dimension: str, total: float, temper: float, given: Mapping[str, float] | None) -> DataFrame:
    """(category, target) with targets that add up to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("mass").alias("m")).where("m > 0")
    if given is None:
        raw = F.pow(F.col("m") / total, temper)
    else:
        weights = F.create_map(*[F.lit(x) for pair in given.items() for x in pair]) if given else F.lit(None)
        raw = F.coalesce(F.try_element_at(weights, F.col(dimension)), F.lit(0.0)) if given else F.lit(1.0)
    raws = sums.select(dimension, raw.cast("double").alias("raw"))
    norm = raws.agg(F.sum("raw")).first()[0] or 1.0
    return raws.select(dimension, (F.col("raw") / norm).alias(f"target_{dimension}"))


def rake(
    cells: DataFrame,
    temper: float = 0.7,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    rounds: int = 20,
    tolerance: float = 1e-9,
) -> DataFrame:
    """``cells`` (source, lang, topic, mass) with ``weight``: the factor that brings its mass to the targets.

    Stops when every marginal is within ``tolerance`` of its target. Targets that no weights meet, as cells without
    documents can make them, end after ``rounds``; a gap of more than ``TOLD`` is then told as a warning.
    """
    total = float(cells.agg(F.sum("mass")).first()[0] or 0)
    if not total:
        return cells.withColumn("weight", F.lit(1.0))
    work = cells.withColumn("x", F.col("mass") / total)
    for dimension in DIMENSIONS:
        aims = _targets(cells, dimension, total, temper, (targets or {}).get(dimension))
        work = work.join(aims, dimension, "left").fillna(0.0, [f"target_{dimension}"])
    work = cut_lineage(work)
    for _ in range(rounds):
        for dimension in DIMENSIONS:
            # summed in the tasks first, so a category with most of the cells is no hot group
            shares = work.groupBy(dimension).agg(F.sum("x").alias("share"))
            moved = F.when(F.col("share") > 0, F.col("x") * F.col(f"target_{dimension}") / F.col("share")).otherwise(0.0)
            work = work.join(shares, dimension).withColumn("x", moved).drop("share")
        work = cut_lineage(work)
        # after a round the last dimension fits exactly; the others tell how far it is from all
        gaps = [
            work.groupBy(d).agg(F.abs(F.sum("x") - F.first(f"target_{d}")).alias("gap")).agg(F.max("gap")).first()[0]
            for d in DIMENSIONS[:-1]
        ]
        if max(gaps) <= tolerance:
            break
    if rounds and max(gaps) > TOLD:
        warnings.warn(f"marginals are off their targets by {max(gaps):.2g} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    weight = F.when(F.col("mass") > 0, F.col("x") * total / F.col("mass")).otherwise(1.0)
    return work.select(*cells.columns, weight.alias("weight"))


def scale(cells: DataFrame, keep_share: float) -> float:
    """The c for which sum(mass · min(1, c · weight)) is ``keep_share`` of what cells with a weight hold.

    Each step assumes the cells that are full at the last c, and solves for the
    others; c only grows, and settles when no further cell gets full.
    """
    c, full = 0.0, -1
    while True:
        is_full = F.col("weight") * c >= 1
        row = cells.where("mass > 0 AND weight > 0").agg(
            F.sum("mass").alias("all"),
            F.sum(F.when(is_full, F.col("mass")).otherwise(0)).alias("in_full"),
            F.sum(F.when(is_full, 0.0).otherwise(F.col("mass") * F.col("weight"))).alias("open"),
            F.count(F.when(is_full, 1)).alias("n"),
        ).first()
        if row["n"] == full or not row["open"]:
            return c if c else 1.0
        full, c = row["n"], (keep_share * row["all"] - row["in_full"]) / row["open"]


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that only the id and the seed decide."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_share: float = 0.9,
    temper: float = 0.7,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    topics: Mapping[str, Sequence[str]] = TOPICS,
    rounds: int = 20,
    seed: int = 1,
) -> DataFrame:
    """``df`` with topic, n_tokens, weight, probability and sampled; ``df`` holds columns source and lang."""
    added = ("topic", "n_tokens", "weight", "probability", "sampled", "_source", "_lang")
    kept = [c for c in df.columns if c not in added]
    marked = df.select(
        *kept,
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("_lang"),
        topic_of(F.col(text_col), topics).alias("topic"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    cells = marked.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic").agg(
        F.sum("n_tokens").cast("double").alias("mass")
    )
    raked = cut_lineage(rake(cut_lineage(cells), temper, targets, rounds))
    c = scale(raked, keep_share)
    odds = raked.select(
        F.col("source").alias("_source"), F.col("lang").alias("_lang"), "topic", "weight",
        F.least(F.lit(1.0), F.col("weight") * c).alias("probability"),
    )
    found = marked.join(F.broadcast(odds) if is_small(odds) else odds, ["_source", "_lang", "topic"])
    sampled = draw(F.col(id_col), seed) < F.col("probability")
    return found.withColumn("sampled", sampled).select(*kept, *added[:5])


def mixing_sql(keep_share: float = 0.9, temper: float = 0.7, rounds: int = 20, seed: int = 1, topics=TOPICS) -> str:
    """The result of ``mix_sources`` over ``documents`` as SQL, for comparison: doc_id, topic, n_tokens, weight, probability, sampled."""
    n = {t: " + ".join(f"contains(low, '{w}')::INT" for w in ws) for t, ws in topics.items()}
    best = f"greatest({', '.join(f'({x})' for x in n.values())})"
    topic = f"CASE WHEN {best} = 0 THEN '{GENERAL}' " + " ".join(f"WHEN ({x}) = {best} THEN '{t}'" for t, x in n.items()) + " END"
    steps, last = [], "aimed"
    for k in range(rounds):
        for d in DIMENSIONS:
            name = f"x{k}_{d}"
            steps.append(
                f"{name} AS (SELECT source, lang, topic, mass, t_source, t_lang, t_topic, "
                f"CASE WHEN sum(x) OVER (PARTITION BY {d}) > 0 THEN x * t_{d} / sum(x) OVER (PARTITION BY {d}) ELSE 0 END AS x FROM {last})"
            )
            last = name
    aims = ", ".join(
        f"aim_{d} AS (SELECT {d}, raw / sum(raw) OVER () AS t_{d} FROM (SELECT {d}, pow(sum(mass) / (SELECT sum(mass) FROM cells), {temper}) AS raw "
        f"FROM cells GROUP BY {d} HAVING sum(mass) > 0))"
        for d in DIMENSIONS
    )
    return f"""
        WITH marked AS (
            SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
                   lower(coalesce(text, '')) AS low, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_tokens
            FROM documents),
        placed AS (SELECT doc_id, source, lang, n_tokens, {topic} AS topic FROM marked),
        cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS mass FROM placed GROUP BY ALL),
        {aims},
        aimed AS (
            SELECT source, lang, topic, mass, coalesce(t_source, 0) AS t_source, coalesce(t_lang, 0) AS t_lang,
                   coalesce(t_topic, 0) AS t_topic, mass / (SELECT sum(mass) FROM cells) AS x
            FROM cells LEFT JOIN aim_source USING (source) LEFT JOIN aim_lang USING (lang) LEFT JOIN aim_topic USING (topic)),
        {', '.join(steps)},
        weighed AS (
            SELECT source, lang, topic, mass,
                   CASE WHEN mass > 0 THEN x * (SELECT sum(mass) FROM cells) / mass ELSE 1 END AS weight FROM {last}),
        ranked AS (
            SELECT weight, {keep_share} * sum(mass) OVER () AS goal, sum(mass * weight) OVER () AS every,
                   coalesce(sum(mass) OVER before, 0) AS full_mass, coalesce(sum(mass * weight) OVER before, 0) AS full_weight,
                   lag(weight) OVER (ORDER BY weight DESC, source, lang, topic) AS heavier
            FROM weighed WHERE mass > 0 AND weight > 0
            WINDOW before AS (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        solved AS (SELECT weight, heavier, (goal - full_mass) / (every - full_weight) AS c FROM ranked),
        scaled AS (SELECT coalesce(max(c), 1) AS c FROM solved WHERE c * weight < 1 AND (heavier IS NULL OR c * heavier >= 1))
        SELECT doc_id, topic, n_tokens::BIGINT AS n_tokens, round(weight, 6) AS weight,
               round(least(1, weight * c), 6) AS probability,
               ('0x' || substr(md5(doc_id || '/{seed}'), 1, 8))::BIGINT / 4294967296.0 < least(1, weight * c) AS sampled
        FROM placed JOIN weighed USING (source, lang, topic), scaled"""
