"""Tagging, ranking, digest and editorial workloads over documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.fixed_values import EVIDENCE_WEIGHTS, STUDY_WEIGHTS
from paperlake.operators import editorial, ranking, tagging
from paperlake.plans import digest as digest_plan
from workloads.registry import any_sql, count_sql, labels_sql, quoted, workload
from workloads.views import LITERATURE, PAPERS, literature, papers

# Dictionaries of words that occur in the corpus.
TOPIC_KEYWORDS = {"thatin": "otology", "rewh": "rhinology", "ononst": "otology", "leaile": "audiology"}
TOPIC_NAMES = ("otology", "rhinology", "audiology", "the_of", "que_les", "general")
DESIGN_RULES = (("cohort", ("thatin", "ouan")), ("rct", ("rewh",)), ("review", ("mente",)))
TERMS = ("orea", "rewh", "sch", "ción", "the ")
TIERS = {"src1": 0.9, "src": 0.4}
TOPIC_WEIGHTS = {"otology": 0.8, "rhinology": 0.7, "audiology": 0.6}
AS_OF = "2024-01-31"

KEYWORD_LABELS = {
    label: any_sql("txt", some) for label, some in tagging.grouped_keywords(TOPIC_KEYWORDS).items()
}
NAME_LABELS = {t: f"contains(txt, {quoted(t.replace('_', ' '))})" for t in TOPIC_NAMES if t != "general"}
DESIGN = "CASE " + " ".join(f"WHEN {any_sql('txt', w)} THEN '{d}'" for d, w in DESIGN_RULES) + " END"
TERM_LABELS = {t: f"contains(txt, {quoted(t)})" for t in TERMS}

def _case(value: str, weights: dict, unknown: float) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in weights.items())
    return f"CASE {value} {whens} ELSE {unknown}::DOUBLE END"


def score_sql(tiers: dict, topic_weights: dict, as_of: str) -> str:
    tier = "CASE " + " ".join(f"WHEN contains(lower(journal), {quoted(k)}) THEN {w}::DOUBLE" for k, w in tiers.items())
    topic = ", ".join(
        f"CASE WHEN list_contains(topics, {quoted(t)}) THEN {w}::DOUBLE ELSE 0.5::DOUBLE END" for t, w in topic_weights.items()
    )
    return f"""least(1::DOUBLE,
  0::DOUBLE + CASE WHEN coalesce(evidence_level, '') <> '' THEN {_case('evidence_level', EVIDENCE_WEIGHTS, 0.2)} * 0.3::DOUBLE ELSE 0.1::DOUBLE END
  + CASE WHEN coalesce(study_design, '') <> '' THEN {_case('study_design', STUDY_WEIGHTS, 0.3)} * 0.25::DOUBLE ELSE 0.05::DOUBLE END
  + {tier} ELSE 0.1::DOUBLE END * 0.2::DOUBLE + greatest(0.5::DOUBLE, {topic}) * 0.15::DOUBLE
  + greatest(0::DOUBLE, 1::DOUBLE - (DATE '{as_of}' - publication_date)::DOUBLE / 365::DOUBLE) * 0.1::DOUBLE)"""


ITEMS = f"""{PAPERS},
tagged AS (SELECT *, {labels_sql(KEYWORD_LABELS)} AS kw, {labels_sql(NAME_LABELS)} AS named, {DESIGN} AS study_design FROM texts),
topical AS (SELECT * EXCLUDE (clinical_importance), list_sort(CASE WHEN len(kw) > 0 THEN kw WHEN len(named) > 0 THEN named ELSE ['general'] END) AS topics,
  list_sort(list_distinct(list_concat(CASE WHEN study_design IS NULL THEN []::VARCHAR[] ELSE [study_design] END, {labels_sql(TERM_LABELS)}))) AS tags
  FROM tagged),
items AS (SELECT *, {score_sql(TIERS, TOPIC_WEIGHTS, AS_OF)} AS score FROM topical)"""

DICTIONARIES = {
    "keywords": TOPIC_KEYWORDS, "topics": TOPIC_NAMES, "fallback": "general", "rules": DESIGN_RULES, "terms": TERMS,
}


def enriched(spark, sf_dir):
    return tagging.enrich_items(papers(spark, sf_dir).drop("topics"), **DICTIONARIES)


def items(spark, sf_dir, rounded=False):
    return ranking.importance(
        enriched(spark, sf_dir), AS_OF, journals=TIERS, topics=TOPIC_WEIGHTS, rounded=rounded
    )


@workload(
    "dictionary_tags",
    f"WITH {PAPERS} SELECT seq, unnest({labels_sql(KEYWORD_LABELS)}) AS label FROM texts",
)
def dictionary_tags(spark, sf_dir):
    labels = tagging.grouped_keywords(TOPIC_KEYWORDS)
    return tagging.tag_by_dictionary(papers(spark, sf_dir), labels).select("seq", "label")


@workload(
    "enriched_items",
    f"WITH {ITEMS} SELECT seq, array_to_string(topics, '|') AS topics, study_design, array_to_string(tags, '|') AS tags FROM items",
)
def enriched_items(spark, sf_dir):
    return enriched(spark, sf_dir).select(
        "seq", F.array_join("topics", "|").alias("topics"), "study_design", F.array_join("tags", "|").alias("tags")
    )


@workload(
    "topic_groups",
    f"""WITH {ITEMS}, m AS (SELECT seq, title, unnest(topics) AS topic FROM items),
f AS (SELECT topic, string_agg('- ' || title, chr(10) ORDER BY seq) AS title_list FROM (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq) <= 5) GROUP BY topic)
SELECT topic, count(*) AS paper_count, min(seq) AS first_seq, any_value(title_list) AS title_list FROM m JOIN f USING (topic) GROUP BY topic""",
)
def topic_groups(spark, sf_dir):
    return tagging.topic_groups(enriched(spark, sf_dir)).select("topic", "paper_count", "first_seq", "title_list")


@workload("importance", f"WITH {ITEMS} SELECT seq, round(score, 6) AS clinical_importance FROM items")
def importance(spark, sf_dir):
    return items(spark, sf_dir).select("seq", F.round("clinical_importance", 6).alias("clinical_importance"))


LITERATURE_TIERS = {"build": 0.9, "furn": 0.3}
LITERATURE_TOPICS = {"PROMO": 0.9, "SMALL": 0.8}


@workload(
    "literature_importance",
    f"""WITH {LITERATURE}, l AS (SELECT * REPLACE (publication_date AS publication_date), NULL::VARCHAR AS study_design FROM literature)
SELECT seq, round({score_sql(LITERATURE_TIERS, LITERATURE_TOPICS, '2001-08-01')}, 6) AS clinical_importance FROM l""",
)
def literature_importance(spark, sf_dir):
    lit = literature(spark, sf_dir).withColumn("study_design", F.lit(None).cast("string"))
    found = ranking.importance(
        lit, "2001-08-01", journals=LITERATURE_TIERS, topics=LITERATURE_TOPICS, rounded=False
    )
    return found.select("seq", F.round("clinical_importance", 6).alias("clinical_importance"))


@workload(
    "trending",
    f"""WITH {ITEMS} SELECT seq, title, round(score, 6) AS clinical_importance FROM items
ORDER BY round(score, 9) DESC, seq LIMIT 10""",
)
def trending(spark, sf_dir):
    scored = items(spark, sf_dir).withColumn("clinical_importance", F.round("clinical_importance", 9))
    return ranking.trending(scored).select("seq", "title", F.round("clinical_importance", 6).alias("clinical_importance"))


QUERIES = {"x": ("thatin OR sch", "rewh"), "y": ("ción",)}


@workload(
    "digest_items",
    f"""WITH {ITEMS},
recent AS (SELECT * FROM items WHERE publication_date BETWEEN DATE '{AS_OF}' - 14 AND DATE '{AS_OF}'),
hits AS (SELECT 'x' AS topic, 'x#0' AS query_id, * FROM recent WHERE contains(txt, 'thatin') OR contains(txt, 'sch')
  UNION ALL SELECT 'x', 'x#1', * FROM recent WHERE contains(txt, 'rewh')
  UNION ALL SELECT 'y', 'y#0', * FROM recent WHERE contains(txt, 'ción'))
SELECT topic AS asked_topic, query_id, source, seq AS article_seq, array_to_string(topics, '|') AS topics FROM hits""",
)
def digest_items(spark, sf_dir):
    found = digest_plan.digest(papers(spark, sf_dir).drop("topics"), "weekly", AS_OF, QUERIES, **DICTIONARIES)
    return found["items"].select(
        F.col("topic").alias("asked_topic"), "query_id", "source", "article_seq", F.array_join("topics", "|").alias("topics")
    )


# --- editorial ---------------------------------------------------------------

NOVELTY = ("thatin", "rewh", "ononst")
PRACTICE = ("sch", "ción", "orea")
IMPACT = ("src1", "src7")
URGENT = ("leaile", "ouan")
STORY = f"""{PAPERS},
story AS (SELECT *, least(1::DOUBLE, clinical_importance * 0.4::DOUBLE
  + least(0.2::DOUBLE, {count_sql('txt', NOVELTY)} * 0.05::DOUBLE) + least(0.2::DOUBLE, {count_sql('txt', PRACTICE)} * 0.04::DOUBLE)
  + CASE WHEN {any_sql('lower(journal)', IMPACT)} THEN 0.2::DOUBLE ELSE 0::DOUBLE END) AS story_score FROM texts)"""
STORY_WORDS = {"novelty": NOVELTY, "practice": PRACTICE, "journals": IMPACT}


@workload(
    "story_scores",
    f"WITH {STORY} SELECT seq, round(story_score, 6) AS story_score FROM story",
)
def story_scores(spark, sf_dir):
    scored = editorial.with_story_score(papers(spark, sf_dir), **STORY_WORDS)
    return scored.select("seq", F.round("story_score", 6).alias("story_score"))


@workload(
    "top_story",
    f"""WITH {STORY} SELECT seq, title, round(story_score, 6) AS story_score FROM
  (SELECT * FROM story ORDER BY story_score DESC, seq LIMIT 1) WHERE story_score >= 0.3""",
)
def top_story(spark, sf_dir):
    best = editorial.top_story(papers(spark, sf_dir), **STORY_WORDS)
    return best.select("seq", "title", F.round("story_score", 6).alias("story_score"))


@workload(
    "breaking",
    f"""WITH {STORY} SELECT seq, round(story_score, 6) AS story_score FROM story
WHERE story_score > 0.613::DOUBLE OR {any_sql('txt', URGENT)}""",
)
def breaking(spark, sf_dir):
    found = editorial.breaking(papers(spark, sf_dir), 0.613, URGENT, **STORY_WORDS)
    return found.select("seq", F.round("story_score", 6).alias("story_score"))


THEME_WORDS = {"North": ("thatin", "ononst"), "South": ("ción", "REWH"), "East": ("sch",), "None": ("no such word",)}


@workload(
    "themes",
    f"""WITH {PAPERS},
m AS (SELECT seq, title, unnest({labels_sql({k: any_sql('txt', v) for k, v in THEME_WORDS.items()})}) AS theme FROM texts),
f AS (SELECT theme, string_agg(title, chr(10) ORDER BY seq) AS titles FROM (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY theme ORDER BY seq) <= 3) GROUP BY theme)
SELECT theme, count(*) AS paper_count, min(seq) AS first_seq, any_value(titles) AS titles,
  CASE WHEN theme = 'North' OR count(*) <= 1 THEN 'emerging' ELSE 'established' END AS momentum
FROM m JOIN f USING (theme) GROUP BY theme""",
)
def themes(spark, sf_dir):
    found = editorial.themes(papers(spark, sf_dir), THEME_WORDS, ("North",))
    return found.withColumn("titles", F.array_join("titles", "\n"))


@workload(
    "merged_topics",
    f"""WITH {LITERATURE},
e AS (SELECT seq, journal, authors[1] AS lead, unnest(topics) AS topic, generate_subscripts(topics, 1) AS pos FROM literature),
g AS (SELECT topic, count(*) AS paper_count, min((seq, pos)) AS first_at FROM e GROUP BY topic HAVING count(*) > 1 ORDER BY first_at LIMIT 3),
l AS (SELECT topic, string_agg(lead, '; ' ORDER BY seq) AS lead_authors FROM (
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY topic ORDER BY seq) <= 3) GROUP BY topic),
j AS (SELECT topic, array_to_string(list_sort(list(DISTINCT journal)), ', ') AS journals FROM e GROUP BY topic)
SELECT topic, paper_count, lead_authors, journals FROM g JOIN l USING (topic) JOIN j USING (topic)""",
)
def merged_topics(spark, sf_dir):
    return editorial.merge_topics(literature(spark, sf_dir)).select("topic", "paper_count", "lead_authors", "journals")


PATTERNS = ((r"\b(?:rewh|thatin)", 0.3), (r"ononst", 0.5), (r"sch|ción", 0.2), (r"leaile", 0.4))
DIRECTIONS = ((("orea", "ouan"), ("rewh", "mente")), (("thon",), ("ge",)))


def _bits() -> list[str]:
    bits = [f"regexp_matches(txt, {quoted(p)})" for p, _ in PATTERNS]
    for positive, negative in DIRECTIONS:
        bits += [any_sql("txt", positive), any_sql("txt", negative)]
    return bits


def _pair_score() -> str:
    parts = [f"CASE WHEN a.b{i} OR b.b{i} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for i, (_, w) in enumerate(PATTERNS)]
    for d in range(len(DIRECTIONS)):
        p, n = len(PATTERNS) + 2 * d, len(PATTERNS) + 2 * d + 1
        parts.append(f"CASE WHEN (a.b{p} AND b.b{n}) OR (a.b{n} AND b.b{p}) THEN 0.4::DOUBLE ELSE 0::DOUBLE END")
    return "least(1::DOUBLE, 0::DOUBLE + " + " + ".join(parts) + ")"


# SQL scores every pair of a source; the Spark form never builds the pairs.
PAIRS = f"""{PAPERS},
f AS (SELECT seq, source AS topic, {', '.join(f'{b} AS b{i}' for i, b in enumerate(_bits()))} FROM texts),
pairs AS (SELECT a.topic, a.seq AS seq_a, b.seq AS seq_b, {_pair_score()} AS score FROM f a JOIN f b ON a.topic = b.topic AND a.seq < b.seq),
conflicts AS (SELECT * FROM pairs WHERE score >= 0.5)"""


@workload(
    "controversies_by_topic",
    f"WITH {PAIRS} SELECT topic, round(score, 6) AS score, count(*)::BIGINT AS n_pairs FROM conflicts GROUP BY topic, round(score, 6)",
)
def controversies_by_topic(spark, sf_dir):
    groups = editorial.controversy_groups(papers(spark, sf_dir), PATTERNS, DIRECTIONS)
    return groups.groupBy("topic", F.round("score", 6).alias("score")).agg(F.sum("n_pairs").alias("n_pairs"))


@workload(
    "controversial_papers",
    f"""WITH {PAIRS} SELECT topic, seq, count(*)::BIGINT AS n_conflicts, round(max(score), 6) AS max_score FROM (
  SELECT topic, seq_a AS seq, score FROM conflicts UNION ALL SELECT topic, seq_b, score FROM conflicts) GROUP BY topic, seq""",
)
def controversial_papers(spark, sf_dir):
    found = editorial.controversial_papers(papers(spark, sf_dir), PATTERNS, DIRECTIONS)
    return found.withColumn("max_score", F.round("max_score", 6))


@workload(
    "controversy_pairs",
    f"""WITH {PAIRS}, ranked AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, seq_a, seq_b)::INT AS rank,
  round(score, 6) AS score, seq_a, seq_b FROM conflicts)
SELECT r.*, a.title AS title_a, b.title AS title_b FROM ranked r JOIN papers a ON a.seq = seq_a JOIN papers b ON b.seq = seq_b WHERE rank <= 25""",
)
def controversy_pairs(spark, sf_dir):
    found = editorial.controversy_pairs(papers(spark, sf_dir), 25, PATTERNS, DIRECTIONS)
    return found.select("topic", "rank", F.round("score", 6).alias("score"), "seq_a", "seq_b", "title_a", "title_b")


FIGURES = """
figures AS (
  SELECT 'papers_reviewed' AS section, 0 AS position, NULL::BIGINT AS seq, NULL::VARCHAR AS title, count(*)::DOUBLE AS value FROM p
  UNION ALL SELECT 'high_evidence', 0, NULL, NULL, count(*) FILTER (WHERE evidence_level IN ('A', 'B'))::DOUBLE FROM p
  UNION ALL SELECT 'practice_changing_papers', 0, NULL, NULL, count(*) FILTER (WHERE clinical_importance >= 0.6)::DOUBLE FROM p
  UNION ALL SELECT 'reading_minutes', 0, NULL, NULL, greatest(1, round_even(sum(length(title) + length(abstract)) / 1500::DOUBLE, 0)) FROM p
  UNION ALL (SELECT 'most_important', 1, seq, title, clinical_importance FROM p ORDER BY clinical_importance DESC, seq LIMIT 1)
  UNION ALL SELECT 'practice_changing', row_number() OVER (ORDER BY seq), seq, title, clinical_importance FROM
    (SELECT * FROM p WHERE clinical_importance >= 0.6 ORDER BY seq LIMIT 5)
  UNION ALL SELECT 'practice_impact', row_number() OVER (ORDER BY seq), seq, title, clinical_importance FROM
    (SELECT * FROM p ORDER BY seq LIMIT 3) WHERE evidence_level IN ('A', 'B'))
SELECT section, position::INT AS position, seq, title, round(value, 6) AS value FROM figures"""


@workload("editorial_digest", f"WITH {PAPERS}, p AS (SELECT * FROM papers), {FIGURES}")
def editorial_digest(spark, sf_dir):
    return editorial.editorial_digest(papers(spark, sf_dir)).withColumn("value", F.round("value", 6))


@workload(
    "weekly_digest",
    f"""WITH {PAPERS}, d AS (SELECT *, publication_date - DATE '2024-01-25' AS day FROM papers
  WHERE publication_date BETWEEN DATE '2024-01-25' AND DATE '2024-01-31'),
p AS (SELECT * REPLACE (day * 1000000000 + seq AS seq) FROM d), {FIGURES}""",
)
def weekly_digest(spark, sf_dir):
    """Seven daily digests read as one."""
    week = editorial.week_of(papers(spark, sf_dir), "2024-01-25")
    figures = editorial.editorial_digest(week)
    return figures.withColumn("seq", F.col("seq.day").cast("long") * 1000000000 + F.col("seq.seq")).withColumn("value", F.round("value", 6))
