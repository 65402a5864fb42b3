"""Quality, author, trend and citation workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.operators import authors, expansion, quality, ranking, trends
from paperlake.plans import discovery as plan
from paperlake.session import cut_lineage
from workloads.documents import TRIM
from workloads.registry import any_sql, labels_sql, quoted, workload
from workloads.views import CITATIONS, LITERATURE, PAPERS, citations, literature, papers

# Patterns that occur in the corpus.
RETRACTED = ("leaile", "ouan")
PREDATORY = (r"src1\d", r"^src[78]$")
CONFERENCE = (r"on\s+the\s+th", r"de\s+la\s")
QUALITY = {"retracted": RETRACTED, "predatory": PREDATORY, "conference": CONFERENCE}


def _pattern_sql(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {quoted(p)})" for p in patterns) + ")"


FLAGGED = f"""
flagged AS (SELECT *, {any_sql('txt', RETRACTED)} AS is_retracted, {_pattern_sql('lower(journal)', PREDATORY)} AS is_predatory,
  {_pattern_sql('txt', CONFERENCE)} AS is_conference_abstract, length(abstract) < 50 AS is_low_quality FROM texts)"""


@workload(
    "quality_flags",
    f"""WITH {PAPERS}, {FLAGGED} SELECT seq, is_retracted, is_predatory, is_conference_abstract, is_low_quality,
  CASE WHEN is_retracted THEN 'retracted' WHEN is_predatory THEN 'predatory' WHEN is_conference_abstract THEN 'conference_abstract'
  WHEN is_low_quality THEN 'low_quality' END AS reject_reason FROM flagged""",
)
def quality_flags(spark, sf_dir):
    flagged = quality.flag_quality(papers(spark, sf_dir), **QUALITY)
    return flagged.select(
        "seq", "is_retracted", "is_predatory", "is_conference_abstract", "is_low_quality", "reject_reason"
    )


FIRST_SEEN = rf"""
by_doi AS (SELECT * FROM {{}} QUALIFY coalesce(doi, '') = '' OR row_number() OVER (PARTITION BY doi ORDER BY seq) = 1),
seen AS (SELECT * FROM by_doi QUALIFY row_number() OVER (PARTITION BY trim(lower(title), {TRIM}) ORDER BY seq) = 1)"""


@workload("first_seen", f"WITH {PAPERS}, {FIRST_SEEN.format('papers')} SELECT seq, title FROM seen")
def first_seen(spark, sf_dir):
    return quality.first_seen(papers(spark, sf_dir)).select("seq", "title")


@workload(
    "quality_filter",
    f"""WITH {PAPERS}, {FLAGGED}, {FIRST_SEEN.format('flagged')}
SELECT seq, title FROM seen WHERE NOT (is_retracted OR is_predatory OR is_conference_abstract OR is_low_quality)""",
)
def quality_filter(spark, sf_dir):
    return quality.quality_filter(papers(spark, sf_dir), **QUALITY).select("seq", "title")


# --- authors -----------------------------------------------------------------

TITLE_TOPICS = {"metal": ("bolt", "anvil", "gear"), "warm": ("red", "hot"), "size": ("small", "large"), "none": ("xyz",)}
MENTIONS = """
mentions AS (SELECT seq, title, unnest(authors) AS author, generate_subscripts(authors, 1) AS pos FROM literature),
counts AS (SELECT author, count(*) AS paper_count, min((seq, pos)) AS first_at FROM mentions GROUP BY author)"""


@workload(
    "author_rank",
    f"""WITH {LITERATURE}, {MENTIONS},
top AS (SELECT * FROM counts ORDER BY paper_count DESC, first_at LIMIT 20),
e AS (SELECT author, seq, unnest({labels_sql({k: any_sql('lower(title)', v) for k, v in TITLE_TOPICS.items()})}) AS topic
  FROM mentions WHERE author IN (SELECT author FROM top)),
n AS (SELECT author, topic, count(*) AS n, min((seq, list_position({list(TITLE_TOPICS)}, topic))) AS first_at FROM e GROUP BY author, topic),
t AS (SELECT author, string_agg(topic, '|' ORDER BY n DESC, first_at) AS top_topics FROM (
  SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, first_at) <= 3) GROUP BY author)
SELECT top.author, paper_count, coalesce(top_topics, '') AS top_topics FROM top LEFT JOIN t USING (author)""",
)
def author_rank(spark, sf_dir):
    ranked = authors.author_rank(literature(spark, sf_dir), 20, TITLE_TOPICS)
    return ranked.select("author", "paper_count", F.array_join("top_topics", "|").alias("top_topics"))


@workload(
    "emerging_authors",
    f"""WITH {LITERATURE}, {MENTIONS}
SELECT author, paper_count FROM (SELECT * FROM counts ORDER BY paper_count DESC, first_at LIMIT 30) WHERE paper_count >= 2
ORDER BY paper_count DESC, first_at LIMIT 5""",
)
def emerging_authors(spark, sf_dir):
    return authors.emerging_authors(literature(spark, sf_dir)).select("author", "paper_count")


@workload(
    "author_papers",
    f"""WITH {LITERATURE}, {MENTIONS}, top AS (SELECT * FROM counts ORDER BY paper_count DESC, first_at LIMIT 20)
SELECT author, seq, title FROM mentions WHERE author IN (SELECT author FROM top)""",
)
def author_papers(spark, sf_dir):
    lit = literature(spark, sf_dir)
    return authors.author_papers(lit, authors.author_rank(lit, 20, TITLE_TOPICS))


@workload(
    "top_institutions",
    f"WITH {LITERATURE} SELECT institution, count(*) AS papers FROM literature GROUP BY institution ORDER BY papers DESC, min(seq) LIMIT 3",
)
def top_institutions(spark, sf_dir):
    return authors.top_institutions(literature(spark, sf_dir), 3).select("institution", "papers")


@workload(
    "top_countries",
    f"WITH {LITERATURE} SELECT country, count(*) AS papers FROM literature GROUP BY country ORDER BY papers DESC, min(seq) LIMIT 10",
)
def top_countries(spark, sf_dir):
    return authors.top_countries(literature(spark, sf_dir), 10).select("country", "papers")


@workload(
    "coauthor_edges",
    f"""WITH {LITERATURE}, {MENTIONS}
SELECT DISTINCT a.author AS src, b.author AS dst FROM mentions a JOIN mentions b ON a.seq = b.seq AND a.pos < b.pos""",
)
def coauthor_edges(spark, sf_dir):
    return authors.coauthor_edges(literature(spark, sf_dir)).select("src", "dst")


@workload(
    "coauthor_weights",
    f"""WITH {LITERATURE}, {MENTIONS}
SELECT src, dst, count(*) AS weight FROM (
  SELECT DISTINCT a.seq, a.author AS src, b.author AS dst FROM mentions a JOIN mentions b ON a.seq = b.seq AND a.pos < b.pos) GROUP BY src, dst""",
)
def coauthor_weights(spark, sf_dir):
    """Lists of more than two authors are cut, so blocks meet one another."""
    return authors.coauthor_edges(literature(spark, sf_dir), block=2)


@workload(
    "collaborators",
    f"""WITH {LITERATURE}, {MENTIONS}
SELECT DISTINCT b.author AS collaborator FROM mentions a JOIN mentions b ON a.seq = b.seq AND a.pos < b.pos WHERE a.author = 'S7'""",
)
def collaborators(spark, sf_dir):
    return authors.collaborators(literature(spark, sf_dir), "S7")


# --- trends ------------------------------------------------------------------

MONITORED = {"red gear": "colour", "hot bolt": "heat", "small anvil": "size", "no such topic": "none", "promo": "type"}
GROWTH = """
growth AS (SELECT topic, this_count, last_count, (this_count - last_count)::DOUBLE / greatest(last_count, 1) * 100 AS growth_rate
  FROM counted WHERE this_count > 0 OR last_count > 0)
SELECT topic, this_count, last_count, this_count + last_count AS paper_count, round(growth_rate, 6) AS growth_rate,
  growth_rate > 50 AND this_count > 5 AS emerging,
  CASE WHEN growth_rate > 100 THEN 'exploding' WHEN growth_rate > 20 THEN 'growing' ELSE 'stable' END AS momentum FROM growth"""
TREND_COLUMNS = ("topic", "this_count", "last_count", "paper_count", "emerging", "momentum")


@workload(
    "topic_trends",
    f"""WITH {LITERATURE},
e AS (SELECT year, unnest({labels_sql({t: f"contains(lower(title || ' ' || abstract), {quoted(t)})" for t in MONITORED})}) AS topic FROM literature),
counted AS (SELECT topic, count(*) FILTER (WHERE year = 1998) AS this_count, count(*) FILTER (WHERE year = 1997) AS last_count
  FROM e GROUP BY topic), {GROWTH}""",
)
def topic_trends(spark, sf_dir):
    found = trends.topic_trends(literature(spark, sf_dir), 1998, MONITORED)
    return found.select(*TREND_COLUMNS, F.round("growth_rate", 6).alias("growth_rate"))


@workload(
    "part_type_trends",
    f"""WITH {LITERATURE}, e AS (SELECT year, unnest(topics) AS topic FROM literature),
counted AS (SELECT topic, count(*) FILTER (WHERE year = 2001) AS this_count, count(*) FILTER (WHERE year = 2000) AS last_count
  FROM e GROUP BY topic), {GROWTH}""",
)
def part_type_trends(spark, sf_dir):
    tagged = literature(spark, sf_dir).select("year", F.explode("topics").alias("topic"))
    found = trends.label_trends(tagged, 2001)
    return found.select(*TREND_COLUMNS, F.round("growth_rate", 6).alias("growth_rate"))


WORD, LETTERS = r"\w", r"[\p{L}\p{M}\p{N}_]"
DEVELOPMENTS = {
    "procedure": (r"(?:thatin|rewh)\s+(\w+(?:\s+\w+)?)\s+(?:the|of|and)", r"(?:ononst)\s+(\w+)"),
    "device": (r"(?:orantion|hehely)\s+(\w+(?:\s+\w+)?)",),
}
MENTION_WORDS = {"technique": ("thatin", "ononst", "sch", "never"), "disease": ("REWH", "ción")}


@workload(
    "new_developments",
    f"""WITH {PAPERS},
m AS (
"""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS category, seq, {n} AS p, unnest(x) AS found, generate_subscripts(x, 1) AS i FROM (SELECT seq, "
        f"regexp_extract_all(title || ' ' || abstract, {quoted('(?i)' + p.replace(WORD, LETTERS))}, 0) AS x FROM papers)"
        for c, some in DEVELOPMENTS.items()
        for n, p in enumerate(some)
    )
    + """),
r AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY seq, p, i) AS rank, trim(found) AS found FROM m),
k AS (
"""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS category, {quoted(w)} AS found WHERE EXISTS (SELECT 1 FROM texts WHERE contains(txt, {quoted(w)}))"
        for c, some in MENTION_WORDS.items()
        for w in some
    )
    + """),
kr AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY found) AS rank, found FROM k)
SELECT category, rank::INT AS rank, found FROM r UNION ALL SELECT category, rank::INT, found FROM kr""",
)
def new_developments(spark, sf_dir):
    return trends.new_developments(papers(spark, sf_dir), DEVELOPMENTS, MENTION_WORDS)


# --- citations ---------------------------------------------------------------

SEEDS = ("10.1/3", "https://doi.org/10.1/17", "10.1/1500")
SEED_VALUES = ", ".join(f"('{s}', '{s.removeprefix('https://doi.org/')}')" for s in SEEDS)


@workload(
    "citation_expansion",
    f"""WITH {LITERATURE}, {CITATIONS}, s(seed_doi, doi) AS (VALUES {SEED_VALUES}),
c AS (SELECT DISTINCT s.seed_doi, c.citing_id FROM s JOIN literature l ON l.doi = s.doi JOIN citations c ON c.cited_id = l.seq),
r AS (SELECT c.seed_doi, l.seq, l.title, row_number() OVER (PARTITION BY seed_doi ORDER BY l.seq)::INT AS rank
  FROM c JOIN literature l ON l.seq = c.citing_id)
SELECT * FROM r WHERE rank <= 5""",
)
def citation_expansion(spark, sf_dir):
    found = expansion.citation_expansion(literature(spark, sf_dir), citations(spark, sf_dir), SEEDS, 5)
    return found.select("seed_doi", "seq", "title", "rank")


def top_orders(lit):
    scored = lit.withColumn("clinical_importance", F.size("authors") / F.lit(10.0))
    return ranking.trending(scored, 10)


@workload(
    "reference_expansion",
    f"""WITH {LITERATURE}, {CITATIONS},
top AS (SELECT * FROM literature ORDER BY len(authors) DESC, seq LIMIT 10),
r AS (SELECT * FROM citations WHERE citing_id IN (SELECT seq FROM top) AND position <= 10)
SELECT r.citing_id, r.position::INT AS rank, l.seq, l.title FROM r JOIN literature l ON l.seq = r.cited_id""",
)
def reference_expansion(spark, sf_dir):
    lit = literature(spark, sf_dir)
    found = expansion.reference_expansion(lit, citations(spark, sf_dir), top_orders(lit), 10)
    return found.select("citing_id", "rank", "seq", "title")


DISCOVERY = {
    "queries": {"gears": ("hot gear OR red gear",), "anvils": ("small anvil", "old anvil")},
    "seeds": SEEDS,
    "institutions": ("NATION_1", "NATION_7"),
    "institution_terms": ("promo", "small"),
    "journals": (("BUILDING", "0000-0001", 2.5),),
    "topics": MONITORED,
    "topic_terms": ("large", "medium"),
}


@workload(
    "discovered_items",
    f"""WITH {LITERATURE}, {CITATIONS}, lt AS (SELECT *, lower(title || ' ' || abstract) AS txt, lower(title || ' ' || abstract || ' ' || affiliation) AS full_txt FROM literature),
kw AS (SELECT 'gears#0' AS ord, * FROM lt WHERE contains(txt, 'hot gear') OR contains(txt, 'red gear')
  UNION ALL SELECT 'anvils#0', * FROM lt WHERE contains(txt, 'small anvil') UNION ALL SELECT 'anvils#1', * FROM lt WHERE contains(txt, 'old anvil')),
s(seed_doi, sdoi) AS (VALUES {SEED_VALUES}),
ci AS (SELECT DISTINCT s.seed_doi AS ord, c.citing_id FROM s JOIN lt ON lt.doi = s.sdoi JOIN citations c ON c.cited_id = lt.seq),
top AS (SELECT * FROM literature ORDER BY len(authors) DESC, seq LIMIT 10),
ins AS (SELECT n AS ord, lt.* FROM lt, (SELECT unnest(['NATION_1', 'NATION_7']) AS n) WHERE contains(full_txt, lower(n))
  AND (contains(full_txt, 'promo') OR contains(full_txt, 'small'))),
tr AS ("""
    + " UNION ALL ".join(
        f"SELECT {quoted(t)} AS ord, * FROM lt WHERE contains(txt, {quoted(t)}) AND (contains(txt, 'large') OR contains(txt, 'medium'))"
        for t in MONITORED
    )
    + """),
found AS (
  SELECT 0 AS n, 'keyword_search' AS strategy, ord, seq, title, doi FROM kw
  UNION ALL SELECT 1, 'citation_expansion', ord, l.seq, l.title, l.doi FROM ci JOIN literature l ON l.seq = ci.citing_id
  UNION ALL SELECT 2, 'reference_expansion', c.citing_id::VARCHAR, l.seq, l.title, l.doi FROM citations c JOIN literature l ON l.seq = c.cited_id
    WHERE c.citing_id IN (SELECT seq FROM top)
  UNION ALL SELECT 3, 'author_tracking', ord, seq, title, doi FROM ins
  UNION ALL SELECT 4, 'journal_tracking', 'BUILDING', seq, title, doi FROM literature WHERE year = 1998 AND journal = 'BUILDING'
  UNION ALL SELECT 5, 'trend_detection', ord, seq, title, doi FROM tr),
d AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doi ORDER BY n, ord, seq) = 1),
t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY n, ord, seq) = 1)
SELECT strategy, ord AS found_by, seq AS article_seq, title FROM t""",
)
def discovered_items(spark, sf_dir):
    lit = literature(spark, sf_dir)
    # abstracts of orders are short, so the length rule is met by padding them
    lit = cut_lineage(lit.withColumn("abstract", F.rpad("abstract", 60, ".")))  # six strategies read it
    found = plan.discover(lit, citations(spark, sf_dir), top_orders(lit), 1998, **DISCOVERY)
    return found["items"].select(
        "strategy", F.col("seq.order").alias("found_by"), F.col("seq.seq").alias("article_seq"), "title"
    )
