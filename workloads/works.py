"""Source records, identity, merging and lookups."""

from __future__ import annotations

import collections
import json
import re

import pyarrow as pa
from pyspark.sql import functions as F

from paperlake.functions.terms import match_terms
from paperlake.functions.text import derive_id, normalize_title
from paperlake.operators import citing, identity, merge
from paperlake.operators.expansion import reference_expansion
from paperlake.operators.parsing import references
from paperlake.plans import literature as plans
from paperlake.session import cut_lineage
from paperlake.sources import bibliographic, fulltext, search
from workloads.documents import TRIM
from workloads.registry import any_sql, workload
from workloads.views import LITERATURE, PAPERS, literature, papers, table

NORM = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"

# Documents as records: exact copies share a DOI (English) or PMCID (German).
RECORDS = rf"""{PAPERS},
records AS (
  SELECT p.*, CASE WHEN p.lang = 'de' THEN 'PMC' || md5(d.text) END AS pmcid,
    CASE WHEN p.lang = 'fr' THEN p.seq::VARCHAR END AS pmid, {NORM.format('p.title')} AS norm
  FROM papers p JOIN documents d ON d.doc_id = p.seq)"""


def records(spark, sf_dir):
    base = papers(spark, sf_dir, hashed=True).drop("topics")
    missing = {
        c: F.lit(None).cast("string")
        for c in ("url", "pdf_url", "publisher", "volume", "issue", "pages", "license")
    }
    return base.withColumns(
        {
            **missing,
            "pmcid": F.when(F.col("lang") == "de", F.concat(F.lit("PMC"), "hash")),
            "pmid": F.when(F.col("lang") == "fr", F.col("seq").cast("string")),
            "language": F.col("lang"),
            "keywords": F.array("lang", "source"),
            "mesh_terms": F.array().cast("array<string>"),
            "publication_type": F.array("journal"),
            "provenance": F.array("source"),
            "retrieved_at": F.timestamp_seconds(F.col("seq") * 60),
        }
    ).drop("hash")


@workload("normalized_titles", f"WITH {RECORDS} SELECT seq, norm AS normalized FROM records")
def normalized_titles(spark, sf_dir):
    return papers(spark, sf_dir).select("seq", normalize_title(F.col("title")).alias("normalized"))


@workload(
    "article_ids",
    f"""WITH {RECORDS} SELECT seq, CASE WHEN doi IS NOT NULL THEN lower(doi) WHEN pmid IS NOT NULL THEN 'pmid:' || pmid
  WHEN pmcid IS NOT NULL THEN 'pmcid:' || lower(pmcid) ELSE 'title:' || trim(lower(title), {TRIM}) END AS article_id
FROM records""",
)
def article_ids(spark, sf_dir):
    cols = [F.col(c) for c in ("doi", "pmid", "pmcid", "title")]
    return records(spark, sf_dir).select("seq", derive_id(*cols).alias("article_id"))


EDGES = f"""{RECORDS},
keyed AS (
  SELECT seq, 'doi' AS kind, lower(doi) AS key FROM records UNION ALL SELECT seq, 'pmid', pmid FROM records
  UNION ALL SELECT seq, 'pmcid', lower(pmcid) FROM records UNION ALL SELECT seq, 'title', norm FROM records),
hubs AS (SELECT kind, key, min(seq) AS src FROM keyed WHERE key <> '' GROUP BY kind, key),
edges AS (SELECT src, seq AS dst, kind FROM keyed JOIN hubs USING (kind, key) WHERE seq <> src)"""


@workload("identity_edges", f"WITH {EDGES} SELECT * FROM edges")
def identity_edges(spark, sf_dir):
    return identity.identity_edges(records(spark, sf_dir))


@workload(
    "similar_titles",
    f"""WITH {RECORDS},
t AS (SELECT min(seq) AS id, list_distinct(string_split(norm, ' ')) AS tokens FROM records WHERE norm <> '' GROUP BY norm),
p AS (
  SELECT a.id AS a, b.id AS b, len(list_intersect(a.tokens, b.tokens)) AS i, len(a.tokens) + len(b.tokens) AS n
  FROM t a JOIN t b ON a.id < b.id AND len(a.tokens) >= 0.9 * len(b.tokens) AND len(b.tokens) >= 0.9 * len(a.tokens))
SELECT a, b, i::DOUBLE / (n - i) AS jaccard FROM p WHERE i::DOUBLE / (n - i) >= 0.9""",
)
def similar_titles(spark, sf_dir):
    return identity.jaccard_pairs(records(spark, sf_dir)).select("a", "b", "jaccard")


@workload(
    "works_by_identity",
    f"""WITH RECURSIVE {EDGES},
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reached(seq, other) AS (
  SELECT seq, seq FROM records UNION SELECT r.seq, e.dst FROM reached r JOIN both_ways e ON e.src = r.other)
SELECT seq, min(other) AS work_id FROM reached GROUP BY seq""",
)
def works_by_identity(spark, sf_dir):
    return identity.resolve_works(records(spark, sf_dir), fuzzy=False).select("seq", "work_id")


# Records joined by identity and by titles whose token sets reach the Jaccard threshold.
WORKS = f"""{EDGES},
titles AS (SELECT min(seq) AS id, list_distinct(string_split(norm, ' ')) AS tokens FROM records WHERE norm <> '' GROUP BY norm),
near_titles AS (
  SELECT a.id AS src, b.id AS dst, len(list_intersect(a.tokens, b.tokens)) AS i, len(a.tokens) + len(b.tokens) AS n
  FROM titles a JOIN titles b ON a.id < b.id AND len(a.tokens) >= 0.9 * len(b.tokens) AND len(b.tokens) >= 0.9 * len(a.tokens)),
links AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM near_titles WHERE i::DOUBLE / (n - i) >= 0.9),
both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links),
reached(seq, other) AS (
  SELECT seq, seq FROM records UNION SELECT r.seq, e.dst FROM reached r JOIN both_ways e ON e.src = r.other),
work AS (SELECT seq, min(other) AS work_id FROM reached GROUP BY seq)"""


@workload("works_by_titles", f"WITH RECURSIVE {WORKS} SELECT * FROM work")
def works_by_titles(spark, sf_dir):
    return identity.resolve_works(records(spark, sf_dir), ratio=False).select("seq", "work_id")


UNIFIED = f"""joined AS (SELECT r.*, w.work_id FROM records r JOIN work w USING (seq)),
merged AS (
  SELECT work_id, arg_min(title, seq) AS title, count(*) AS n_records, arg_min(year, seq) AS year,
    arg_min(doi, seq) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(pmid, seq) FILTER (WHERE pmid IS NOT NULL) AS pmid,
    arg_min(pmcid, seq) FILTER (WHERE pmcid IS NOT NULL) AS pmcid FROM joined GROUP BY work_id),
origins AS (
  SELECT work_id, string_agg(source, '|' ORDER BY first_at) AS provenance FROM (
    SELECT work_id, source, min(seq) AS first_at FROM joined GROUP BY work_id, source) GROUP BY work_id),
unified AS (
  SELECT work_id, CASE WHEN doi IS NOT NULL THEN lower(doi) WHEN pmid IS NOT NULL THEN 'pmid:' || pmid
    WHEN pmcid IS NOT NULL THEN 'pmcid:' || lower(pmcid) ELSE 'title:' || trim(lower(title), {TRIM}) END AS article_id,
    title, n_records, provenance FROM merged JOIN origins USING (work_id))"""


def unified(found):
    return found.select("work_id", "article_id", "title", "n_records", F.array_join("provenance", "|").alias("provenance"))


@workload("unified_by_titles", f"WITH RECURSIVE {WORKS}, {UNIFIED} SELECT * FROM unified")
def unified_by_titles(spark, sf_dir):
    return unified(plans.unify(records(spark, sf_dir), ratio=False))


FOUND = RECORDS.replace("\nrecords AS (", "\nall_records AS (") + """,
records AS (SELECT * FROM all_records WHERE year BETWEEN 2003 AND 2015
  AND (contains(lower(title || ' ' || abstract), 'the') OR contains(lower(title || ' ' || abstract), 'ción')))"""


@workload("searched_works", f"WITH RECURSIVE {WORKS.replace(RECORDS, FOUND)}, {UNIFIED} SELECT * FROM unified")
def searched_works(spark, sf_dir):
    """Two queries over the records of some years, merged."""
    queries = {"first": "the", "second": "ción OR the"}
    return unified(plans.search_works(records(spark, sf_dir), queries, from_year=2003, to_year=2015, ratio=False))


@workload("works")
def works(spark, sf_dir):
    """Works by identity and similar titles; the sequence ratio has no SQL form."""
    return identity.resolve_works(records(spark, sf_dir)).select("seq", "work_id")


@workload("unified_works")
def unified_works(spark, sf_dir):
    found = plans.unify(records(spark, sf_dir))
    return found.select("work_id", "article_id", "title", "n_records", F.array_join("provenance", "|").alias("provenance"))


@workload(
    "merged_works",
    f"""WITH {RECORDS},
w AS (SELECT *, min(seq) OVER (PARTITION BY norm) AS work_id FROM records),
scalars AS (
  SELECT work_id, arg_min(title, seq) AS title, arg_min(journal, seq) AS journal, arg_min(year, seq) AS year,
    arg_min(doi, seq) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(pmid, seq) FILTER (WHERE pmid IS NOT NULL) AS pmid,
    arg_min(pmcid, seq) FILTER (WHERE pmcid IS NOT NULL) AS pmcid, md5(arg_min(abstract, seq)) AS abstract_md5,
    max(seq) * 60 AS retrieved, count(*) AS n_records FROM w GROUP BY work_id),
keys AS (
  SELECT work_id, string_agg(k, '|' ORDER BY first_at) AS keywords FROM (
    SELECT work_id, k, min(seq * 10 + n) AS first_at FROM (
      SELECT work_id, seq, 0 AS n, lang AS k FROM w UNION ALL SELECT work_id, seq, 1, source FROM w)
    GROUP BY work_id, k) GROUP BY work_id),
origins AS (
  SELECT work_id, string_agg(source, '|' ORDER BY first_at) AS provenance FROM (
    SELECT work_id, source, min(seq) AS first_at FROM w GROUP BY work_id, source) GROUP BY work_id)
SELECT s.*, k.keywords, o.provenance,
  CASE WHEN doi IS NOT NULL THEN lower(doi) WHEN pmid IS NOT NULL THEN 'pmid:' || pmid
  WHEN pmcid IS NOT NULL THEN 'pmcid:' || lower(pmcid) ELSE 'title:' || trim(lower(title), {TRIM}) END AS article_id
FROM scalars s JOIN keys k USING (work_id) JOIN origins o USING (work_id)""",
)
def merged_works(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("norm", normalize_title(F.col("title")))
    first = rows.groupBy("norm").agg(F.min("seq").alias("work_id"))
    merged = merge.merge_works(rows.join(first, "norm").drop("norm"))
    return merged.select(
        "work_id", "article_id", "title", "journal", "year", "doi", "pmid", "pmcid",
        F.md5("abstract").alias("abstract_md5"),
        F.unix_seconds("retrieved_at").alias("retrieved"),
        "n_records",
        F.array_join("keywords", "|").alias("keywords"),
        F.array_join("provenance", "|").alias("provenance"),
    )


# --- raw records -------------------------------------------------------------


def raw_pubmed(spark, sf_dir):
    """Orders written out as raw records of the first source."""
    lit = literature(spark, sf_dir)
    record = F.struct(
        F.col("seq").cast("string").alias("uid"),
        "title",
        F.lit("").alias("fulljournalname"),
        F.col("journal").alias("source"),
        F.date_format("publication_date", "yyyy MMM d").alias("pubdate"),
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
        F.array(F.struct(F.lit("doi").alias("idtype"), F.col("doi").alias("value"))).alias("articleids"),
        F.array(
            F.struct(F.col("abstract").alias("text")), F.struct(F.col("affiliation").alias("text"))
        ).alias("abstracttext"),
        F.col("topics").alias("keywords"),
        F.array(F.lit("eng")).alias("lang"),
    )
    return lit.select(F.to_json(record).alias("record"))


def raw_europepmc(spark, sf_dir):
    lit = literature(spark, sf_dir)
    record = F.struct(
        "title",
        F.array_join("authors", " , ").alias("authorString"),
        F.struct(
            F.struct(F.col("journal").alias("title"), F.col("institution").alias("publisher")).alias("journal"),
            F.col("year").cast("string").alias("year"),
        ).alias("journalInfo"),
        "doi",
        F.col("abstract").alias("abstractText"),
        F.struct(F.col("topics").alias("keyword")).alias("keywordList"),
        F.transform("topics", lambda t: F.struct(t.alias("term"))).alias("meshTermList"),
        F.struct(
            F.array(F.struct(F.lit("PDF").alias("documentStyle"), F.concat(F.lit("http://x/"), "seq").alias("url"))).alias(
                "fullTextUrl"
            )
        ).alias("fullTextUrlList"),
    )
    return lit.select(F.to_json(record).alias("record"))


SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
TO_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def inverted(texts):
    """The JSON of the map word -> positions of some texts."""
    index = collections.defaultdict(list)
    for text in texts:
        for pos, word in enumerate(SPACE.split(text.strip(" "))):
            index[word].append(pos)
    if len(texts) > 1:
        for positions in index.values():
            positions.sort()
    return TO_JSON(dict(sorted(index.items())))


def indexed(batches):
    """(doc_id, idx) of (doc_id, texts)."""
    for batch in batches:
        idx = pa.array((inverted(texts) for texts in batch.column("texts").to_pylist()), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), idx], ["doc_id", "idx"])


def raw_openalex(spark, sf_dir):
    """Documents as works whose abstract is a word -> positions index of the whole text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    texts = docs.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))  # texts of one id share an index
    index = texts.mapInArrow(indexed, "doc_id long, idx string")
    record = F.struct(
        F.concat(F.lit("W"), "doc_id").alias("id"),
        F.concat(F.lit("Work "), "doc_id").alias("title"),
        F.lit(2020).alias("publication_year"),
        F.struct(F.col("doc_id").cast("string").alias("pmid")).alias("ids"),
        F.array(F.struct(F.lit("concept").alias("display_name"))).alias("concepts"),
    )
    # the index, JSON already, goes in as the last field
    opened = F.regexp_replace(F.to_json(record), r"\}$", "")
    return index.select(F.concat(opened, F.lit(',"abstract_inverted_index":'), "idx", F.lit("}")).alias("record"))


@workload(
    "pubmed_articles",
    f"""WITH {LITERATURE} SELECT seq::VARCHAR AS pmid, title, journal, year, doi, abstract || ' ' || affiliation AS abstract,
  'https://pubmed.ncbi.nlm.nih.gov/' || seq || '/' AS url, 'eng' AS language, array_to_string(authors, '|') AS authors,
  array_to_string(topics, '|') AS keywords FROM literature""",
)
def pubmed_articles(spark, sf_dir):
    found = bibliographic.normalize_pubmed(raw_pubmed(spark, sf_dir))
    return found.select(
        "pmid", "title", "journal", "year", "doi", "abstract", "url", "language",
        F.array_join("authors", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"),
    )


@workload(
    "europepmc_articles",
    f"""WITH {LITERATURE} SELECT title, journal, year, doi, abstract, institution AS publisher, 'http://x/' || seq AS pdf_url,
  array_to_string(authors, '|') AS authors, array_to_string(topics, '|') AS keywords, array_to_string(topics, '|') AS mesh_terms
FROM literature""",
)
def europepmc_articles(spark, sf_dir):
    found = bibliographic.normalize_europepmc(raw_europepmc(spark, sf_dir))
    return found.select(
        "title", "journal", "year", "doi", "abstract", "publisher", "pdf_url",
        *[F.array_join(c, "|").alias(c) for c in ("authors", "keywords", "mesh_terms")],
    )


@workload(
    "openalex_articles",
    rf"""SELECT doc_id::VARCHAR AS pmid, 'Work ' || doc_id AS title, 'W' || doc_id AS url, 2020::INT AS year, 'concept' AS mesh_terms,
  md5(array_to_string(string_split_regex(trim(text), '\s+'), ' ')) AS abstract_md5 FROM documents""",
)
def openalex_articles(spark, sf_dir):
    found = bibliographic.normalize_openalex(raw_openalex(spark, sf_dir))
    return found.select(
        "pmid", "title", "url", "year", F.array_join("mesh_terms", "|").alias("mesh_terms"),
        F.md5("abstract").alias("abstract_md5"),
    )


@workload(
    "loaded_articles",
    f"""WITH {LITERATURE} SELECT 'pubmed' AS source, count(*) AS n, count(DISTINCT doi) AS n_doi FROM literature
UNION ALL SELECT 'europepmc', count(*), count(DISTINCT doi) FROM literature
UNION ALL SELECT 'openalex', count(*), 0 FROM documents
UNION ALL SELECT 'quarantine', count(*), 0 FROM benchmark""",
)
def loaded_articles(spark, sf_dir):
    """All three sources in one frame; benchmark texts are no JSON and end in quarantine."""
    broken = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("{"), "text").alias("record"))
    good, quarantine, _ = bibliographic.load_articles(
        {
            "pubmed": raw_pubmed(spark, sf_dir).unionByName(broken),
            "europepmc": raw_europepmc(spark, sf_dir),
            "openalex": raw_openalex(spark, sf_dir),
        },
        columns=["source", "doi"],
    )
    counts = good.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doi").alias("n_doi"))
    held = quarantine.agg(F.lit("quarantine").alias("source"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_doi"))
    return counts.unionByName(held.select(*counts.columns))


# --- search ------------------------------------------------------------------

QUERY_TERMS = {"q1": "thatin OR ononst", "q2": "Rewh OR inoran", "q3": "leaile"}


@workload(
    "term_search",
    f"""WITH {PAPERS}, hits AS ("""
    + " UNION ALL ".join(
        f"SELECT '{q}' AS query_id, * FROM texts WHERE {any_sql('txt', search.split_terms(terms))}"
        for q, terms in QUERY_TERMS.items()
    )
    + """)
SELECT query_id, source, seq FROM hits""",
)
def term_search(spark, sf_dir):
    return search.term_search(papers(spark, sf_dir), QUERY_TERMS).select("query_id", "source", "seq")


@workload(
    "term_search_first",
    f"""WITH {PAPERS}, hits AS ("""
    + " UNION ALL ".join(
        f"SELECT '{q}' AS query_id, * FROM texts WHERE {any_sql('txt', search.split_terms(terms))}"
        for q, terms in QUERY_TERMS.items()
    )
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY seq)::INT AS rank FROM hits)
SELECT query_id, source, rank, seq FROM r WHERE rank <= 5""",
)
def term_search_first(spark, sf_dir):
    """The queries as a frame, and the first five hits of each source."""
    asked = spark.createDataFrame(list(QUERY_TERMS.items()), "query_id string, query string")
    found = search.term_search(papers(spark, sf_dir), asked, limit=5)
    return found.select("query_id", "source", "rank", "seq")


@workload(
    "topic_search",
    f"""WITH {PAPERS}, hits AS (
SELECT 'a' AS topic, 'a#0' AS query_id, * FROM texts WHERE contains(txt, 'thatin') UNION ALL
SELECT 'a', 'a#1', * FROM texts WHERE contains(txt, 'ononst') UNION ALL
SELECT 'a', 'a#2', * FROM texts WHERE contains(txt, 'leaile') UNION ALL
SELECT 'b', 'b#0', * FROM texts WHERE contains(txt, 'rewh') OR contains(txt, 'inoran'))
SELECT topic, query_id, source, seq FROM hits""",
)
def topic_search(spark, sf_dir):
    queries = {"a": ["thatin", "ononst", "leaile"], "b": ["rewh OR inoran"]}
    found = search.topic_search(papers(spark, sf_dir), queries)
    return found.select("topic", "query_id", "source", "seq")


@workload("year_range", f"WITH {LITERATURE} SELECT seq, year FROM literature WHERE year >= 1996 AND year <= 1998")
def year_range(spark, sf_dir):
    return search.year_range(literature(spark, sf_dir), 1996, 1998).select("seq", "year")


@workload(
    "lookup",
    f"""WITH {LITERATURE}, m AS (
  SELECT '10.1/7' AS identifier, seq FROM literature WHERE lower(doi) = '10.1/7' UNION ALL
  SELECT 'PMC12', seq FROM literature WHERE seq = 12 UNION ALL
  SELECT '33', seq FROM literature WHERE seq = 33 UNION ALL
  SELECT 'hot gear red', seq FROM literature WHERE contains(lower(title), 'hot gear red'))
SELECT identifier, min(seq) AS seq FROM m GROUP BY identifier""",
)
def lookup(spark, sf_dir):
    articles = literature(spark, sf_dir).withColumns(
        {"pmcid": F.concat(F.lit("pmc"), "seq"), "pmid": F.col("seq").cast("string")}
    )
    wanted = spark.createDataFrame([("10.1/7",), ("PMC12",), ("33",), ("hot gear red",)], "identifier string")
    return search.lookup(articles, wanted).select("identifier", "seq")


NATIONS = ("NATION_1", "NATION_7", "NATION_20")


@workload(
    "institution_feed",
    f"""WITH {LITERATURE}, hits AS ("""
    + " UNION ALL ".join(
        f"SELECT '{n}' AS hit, * FROM literature WHERE contains(lower(title || ' ' || abstract || ' ' || affiliation), lower('{n}')) "
        "AND (contains(lower(title || ' ' || abstract || ' ' || affiliation), 'promo') "
        "OR contains(lower(title || ' ' || abstract || ' ' || affiliation), 'small'))"
        for n in NATIONS
    )
    + """) SELECT hit AS institution, seq, unnest(authors) AS author FROM hits""",
)
def institution_feed(spark, sf_dir):
    _, authors = search.institution_feed(literature(spark, sf_dir), NATIONS, ("promo", "small"))
    return authors.select("institution", "seq", "author")


WORDS_OF = r"\s+"


@workload(
    "dictionary_hits",
    r"""WITH terms AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM benchmark) WHERE length(term) > 3)
SELECT d.doc_id, count(*) AS n_terms, min(term) AS first_term, max(term) AS last_term
FROM documents d JOIN terms ON contains(lower(d.text), term) GROUP BY d.doc_id""",
)
def dictionary_hits(spark, sf_dir):
    """All longer words of the benchmark items as a dictionary, over all documents."""
    words = F.explode(F.split(F.lower("text"), WORDS_OF)).alias("term")
    terms = table(spark, sf_dir, "benchmark").select(words).where("length(term) > 3").distinct()
    # numbers in the order of the terms: the first and last of a text are found without sorting its hits
    terms = cut_lineage(terms.orderBy("term").withColumn("place", F.monotonically_increasing_id()))
    found = match_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), terms)
    ends = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.min("place").alias("first"), F.max("place").alias("last")
    )
    named = lambda place, name: terms.select(F.col("place").alias(place), F.col("term").alias(name))
    ends = ends.join(named("first", "first_term"), "first").join(named("last", "last_term"), "last")
    return ends.select("doc_id", "n_terms", "first_term", "last_term")


# Each line of an order cites the order that its part key names, in one of three ways.
CITED = f"""WITH {LITERATURE},
r AS (SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)::INT AS position,
  l_partkey % 3 AS how, c.doi, string_split(c.title, ' ') AS ws, c.year FROM lineitem JOIN literature c ON c.seq = l_partkey),
refs AS (SELECT document_id, position, how, doi, CASE WHEN how = 2 THEN ws[:-2] ELSE ws END AS ws, year FROM r),
by_doi AS (SELECT document_id, position, seq AS cited_id, 'doi' AS by, 0 AS missing FROM refs JOIN literature USING (doi) WHERE how = 0),
ref_keys AS (SELECT DISTINCT document_id, position, year, m, key FROM (
  SELECT document_id, position, year, 0 AS m, array_to_string(ws, ' ') AS key FROM refs WHERE how > 0 AND len(ws) >= 3 UNION ALL
  SELECT document_id, position, year, 1, unnest(list_transform(range(1, len(ws) + 1), lambda k: array_to_string(list_concat(ws[:k - 1], ws[k + 1:]), ' ')))
  FROM refs WHERE how > 0 AND len(ws) >= 3)),
lw AS (SELECT seq, year, string_split(title, ' ') AS ws FROM literature),
work_keys AS (SELECT year, m, key, min(seq) AS seq FROM (
  SELECT seq, year, 0 AS m, array_to_string(ws, ' ') AS key FROM lw WHERE len(ws) >= 3 UNION ALL
  SELECT seq, year, 1, unnest(list_transform(range(1, len(ws) + 1), lambda k: array_to_string(list_concat(ws[:k - 1], ws[k + 1:]), ' ')))
  FROM lw WHERE len(ws) >= 3) GROUP BY year, m, key),
by_title AS (SELECT document_id, position, w.seq AS cited_id, 'title' AS by, r.m + w.m AS missing FROM ref_keys r JOIN work_keys w ON w.key = r.key
  AND abs(w.year - r.year) <= 1
  QUALIFY row_number() OVER (PARTITION BY document_id, position ORDER BY r.m + w.m, abs(w.year - r.year), w.seq) = 1),
links AS (SELECT * FROM by_doi UNION ALL SELECT * FROM by_title)"""


def cited_texts(spark, sf_dir):
    """Documents that are lists of references: with a DOI, with a title in quotes, or with a title that lacks its last word."""
    works = literature(spark, sf_dir).withColumn("doi", F.concat(F.lit("10.1234/"), "seq"))
    works = cut_lineage(works.select("seq", "work_id", "doi", "title", "year", "authors"))  # texts and links both need them
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    met = lines.join(works.select(F.col("seq").alias("l_partkey"), "doi", "title", "year"), "l_partkey")
    how, year = F.col("l_partkey") % 3, F.col("year").cast("string")
    short = F.array_join(F.slice(F.split("title", " "), 1, F.greatest(F.size(F.split("title", " ")) - 1, F.lit(0))), " ")
    body = (
        F.when(how == 0, F.concat(F.lit("Doe J, Roe A. Some other words. J Parts. "), year, F.lit(";12(3):1-5. doi: "), "doi"))
        .when(how == 1, F.concat(F.lit('Doe, J., & Roe, A. "'), "title", F.lit('". J Parts ('), year, F.lit(").")))
        .otherwise(F.concat(F.lit("Doe J, Roe A. "), short, F.lit(". J Parts. "), year, F.lit(";12(3):1-5.")))
    )
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", body.alias("body"))))
    grouped = met.groupBy(F.col("l_orderkey").alias("document_id")).agg(listed.alias("rows"))
    text = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit("["), i + 1, F.lit("] "), x.body)), "\n")
    return grouped.select("document_id", text.alias("text")), works


@workload("citation_links", f"{CITED} SELECT * FROM links")
def citation_links(spark, sf_dir):
    """References parsed from texts, linked with the works they name."""
    texts, works = cited_texts(spark, sf_dir)
    found = citing.segmented(references(texts).where("raw_text <> ''"))
    # texts start with an item, so the first position is 0
    return citing.link_references(found, works).withColumn("position", F.col("position") + 1)


@workload(
    "cited_works",
    f"""{CITED}, e AS (SELECT document_id AS citing_id, cited_id, min(position) AS position FROM links WHERE document_id <> cited_id GROUP BY ALL),
top AS (SELECT * FROM literature ORDER BY len(authors) DESC, seq LIMIT 10)
SELECT e.citing_id, l.seq, l.title FROM e JOIN literature l ON l.seq = e.cited_id WHERE e.citing_id IN (SELECT seq FROM top)""",
)
def cited_works(spark, sf_dir):
    """The works that the references of the ten orders with most authors name."""
    texts, works = cited_texts(spark, sf_dir)
    links = citing.link_references(citing.segmented(references(texts).where("raw_text <> ''")), works)
    top = works.orderBy(F.size("authors").desc(), "seq").limit(10)
    found = reference_expansion(works, citing.citation_edges(links), top)
    return found.select("citing_id", "seq", "title")


JOURNALS = (("BUILDING", "0000-0001", 2.5), ("MACHINERY", "0000-0002", 1.25), ("NO SUCH", "0000-0003", 9.0))
JOURNAL_VALUES = ", ".join(f"({i}::INT, '{a}', '{b}', {c}::DOUBLE)" for i, (a, b, c) in enumerate(JOURNALS))


@workload(
    "journal_feed",
    f"""WITH {LITERATURE}
SELECT journal, seq, title FROM literature WHERE year = 1997 AND journal IN ('BUILDING', 'MACHINERY')""",
)
def journal_feed(spark, sf_dir):
    feed, _ = search.journal_feed(literature(spark, sf_dir), JOURNALS, 1997)
    return feed.select("journal", "seq", "title")


@workload(
    "journal_report",
    f"""WITH {LITERATURE}, j(position, journal, issn, impact_factor) AS (VALUES {JOURNAL_VALUES}),
c AS (SELECT journal, count(*) AS n FROM literature WHERE year = 1997 GROUP BY journal)
SELECT j.*, coalesce(c.n, 0)::BIGINT AS papers_this_period FROM j LEFT JOIN c USING (journal)""",
)
def journal_report(spark, sf_dir):
    return search.journal_feed(literature(spark, sf_dir), JOURNALS, 1997)[1]


@workload(
    "fulltext_candidates",
    f"""WITH {LITERATURE}, c AS (
  SELECT seq, 0 AS p, 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || seq || '/pdf/' AS url, 'application/pdf' AS mime_type, 'pmc' AS resolver FROM literature
  UNION ALL SELECT seq, 1, 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || seq || '/pdf/main.pdf', 'application/pdf', 'pmc' FROM literature
  UNION ALL SELECT seq, 2, 'https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pmc&id=PMC' || seq || '&rettype=xml&retmode=xml', 'application/xml', 'pmc' FROM literature
  UNION ALL SELECT seq, 3, 'https://doi.org/' || doi, 'text/html', 'doi' FROM literature
  UNION ALL SELECT seq, 4, 'http://x/' || (seq % 2), 'application/pdf', 'publisher' FROM literature
  UNION ALL SELECT seq, 5, 'http://x/1', 'text/html', 'publisher' FROM literature WHERE seq % 2 = 0)
SELECT seq AS article_id, row_number() OVER (PARTITION BY seq ORDER BY p)::INT AS rank, url, mime_type, resolver FROM c""",
)
def fulltext_candidates(spark, sf_dir):
    articles = literature(spark, sf_dir).withColumns(
        {
            "article_id": F.col("seq"),
            "pmcid": F.concat(F.lit("PMC"), "seq"),
            "pdf_url": F.concat(F.lit("http://x/"), F.col("seq") % 2),
            "url": F.lit("http://x/1"),
        }
    )
    return fulltext.fulltext_candidates(articles)


@workload(
    "audited_files",
    """WITH f AS (
  SELECT page_id AS path, sha256(html) AS sha256, strlen(html)::BIGINT AS size,
    starts_with(html, '<!DOCTYPE') OR starts_with(html, '<html') OR starts_with(html, '<HTML') AS is_html FROM pages
  UNION ALL
  SELECT 1000000000 + doc_id, sha256('%PDF-' || text), strlen('%PDF-' || text)::BIGINT, false FROM documents),
m AS (SELECT *, CASE WHEN is_html THEN 'html_page' WHEN path < 1000000000 THEN 'mime_type' END AS problem FROM f)
SELECT path, m.sha256, size, problem, count(*) OVER (PARTITION BY m.sha256) AS copies,
  path <> min(path) OVER (PARTITION BY m.sha256) AS is_copy, substr(m.sha256, 1, 2) AS prefix1, substr(m.sha256, 3, 2) AS prefix2
FROM m""",
)
def audited_files(spark, sf_dir):
    """Web pages as fetched files that should be PDF, and documents as PDF contents."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.encode("html", "UTF-8").alias("content"))
    docs = table(spark, sf_dir, "documents").select(
        (F.lit(1000000000) + F.col("doc_id")).alias("path"),
        F.encode(F.concat(F.lit("%PDF-"), "text"), "UTF-8").alias("content"),
    )
    return fulltext.audit_contents(pages.unionByName(docs)).drop("mime_type")
