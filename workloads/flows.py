"""Whole flows from end to end, reads of the knowledge base, and SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.functions.sql import register_sql_functions
from paperlake.operators import retrieval
from paperlake.operators.chunking import chunk_fixed
from paperlake.plans.answers import answer_contexts as answers
from paperlake.plans.editorial import editorial
from paperlake.plans.ingest import index_documents
from paperlake.sources import knowledge_base as kb
from workloads import digests
from workloads.documents import FIXED, TRIM
from workloads.registry import SQL, workload
from workloads.vectors import CENTROIDS, centroids, rounded
from workloads.views import PAPERS, chunk_vectors, documents, papers, table
from workloads.works import NORM

# --- questions to contexts -----------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(df, text_col):
    """A vector that SQL can compute as well: how often each letter occurs."""
    text = F.lower(F.col(text_col))
    counts = [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("float") for c in LETTERS]
    return df.withColumn("embedding", F.array(*counts))


retrieval.register_embedder("letter_counts", letter_counts)
LETTERS_SQL = "list_transform(string_split('" + LETTERS + "', ''), lambda c: (length(lower({0})) - length(replace(lower({0}), c, '')))::DOUBLE)"

ANSWERS = f"""{FIXED},
q AS (SELECT item_id AS query_id, text AS question, {LETTERS_SQL.format('text')} AS v FROM benchmark),
cv AS (SELECT document_id, chunk_index, document_id * 1000000 + chunk_index AS chunk_id, text, {LETTERS_SQL.format('text')} AS v FROM chunks),
scored AS (SELECT query_id, chunk_id, document_id, text, round(greatest(list_cosine_similarity(q.v, cv.v), 0), 12) AS score FROM q, cv),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
g AS (SELECT query_id, string_agg('[' || document_id || '] ' || text || chr(10), chr(10) ORDER BY rank) AS context,
  array_to_string(list_sort(list(DISTINCT document_id)), '|') AS sources, avg(score) AS confidence, count(*) AS n_chunks
  FROM ranked WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, question, md5(context) AS context_md5, sources, round(confidence, 6) AS confidence, n_chunks
FROM q JOIN g USING (query_id)"""


@workload("answer_contexts", f"WITH {ANSWERS}")
def answer_contexts(spark, sf_dir):
    """Benchmark texts as questions: embedded, searched over all chunks, and answered with contexts."""
    number = F.col("document_id") * 1000000 + F.col("chunk_index")
    chunks = chunk_fixed(documents(spark, sf_dir)).withColumn("chunk_id", number)
    chunks = chunks.select("chunk_id", "document_id", "text")
    vectors = retrieval.embed(chunks, "text", "letter_counts")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    found = answers(questions, chunks, vectors, k=5, embedder="letter_counts")
    return found.select(
        "query_id", "question", F.md5("context").alias("context_md5"), F.array_join("sources", "|").alias("sources"),
        F.round("confidence", 6).alias("confidence"), "n_chunks",
    )


@workload(
    "embedded_letters",
    f"""WITH {FIXED} SELECT printf('%d_chunk_%04d', document_id, chunk_index) AS chunk_id, 26::INT AS dimensions,
  array_to_string(list_transform({LETTERS_SQL.format('text')}, lambda x: x::BIGINT), ' ') AS counts FROM chunks""",
)
def embedded_letters(spark, sf_dir):
    """The vectors that indexing writes with an embedder of the caller's."""
    found = index_documents(documents(spark, sf_dir), embedder="letter_counts")["embeddings"]
    counts = F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), " ")
    return found.select("chunk_id", "dimensions", counts.alias("counts"))


@workload(
    "vector_search_section",
    f"""WITH {CENTROIDS.replace("label::BIGINT AS document_id, embedding", "label::BIGINT AS document_id, 'part ' || vec_id % 4 AS section, embedding")
        .replace("SELECT query_id, chunk_id, document_id, round", "SELECT query_id, chunk_id, document_id, section, round")},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored
  WHERE section IN ('part 1', 'part 2'))
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
)
def vector_search_section(spark, sf_dir):
    """Only chunks of two sections take part."""
    vectors = chunk_vectors(spark, sf_dir).withColumn("section", F.concat(F.lit("part "), F.col("chunk_id") % 4))
    found = retrieval.vector_search(centroids(spark, sf_dir), vectors, 5, where=F.col("section").isin("part 1", "part 2"))
    return rounded(found)


# --- reads of the knowledge base -----------------------------------------------


def written_tables(spark, sf_dir):
    """All documents indexed, those in French again in capitals, toxic ones deleted."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    first = index_documents(docs.select("document_id", "text"))
    again = index_documents(docs.where("lang = 'fr'").select("document_id", F.upper("text").alias("text")))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return kb.without_documents(kb.indexed_over(first, again), toxic)


REWRITTEN = FIXED.replace(
    "FROM documents)",
    """FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN upper(text) ELSE text END AS text FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)))""",
    1,
)


def asked_ids(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("document_id"))


@workload(
    "read_documents",
    f"""WITH {REWRITTEN}, sums AS (SELECT document_id, count(*) AS c, sum(word_count) AS w FROM chunks GROUP BY document_id)
SELECT doc_id AS document_id, coalesce(c, 0)::BIGINT AS total_chunks, coalesce(w, 0)::BIGINT AS total_words,
  doc_id IN (SELECT item_id * 3 FROM benchmark) AS asked
FROM documents LEFT JOIN sums ON sums.document_id = doc_id WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def read_documents(spark, sf_dir):
    """The listed documents, and which of them were asked for."""
    held = written_tables(spark, sf_dir)["documents"]
    asked = kb.rows_of(held, asked_ids(spark, sf_dir)).select("document_id", F.lit(True).alias("asked"))
    listed = kb.newest_first(held).join(asked, "document_id", "left")
    return listed.select("document_id", "total_chunks", "total_words", F.coalesce("asked", F.lit(False)).alias("asked"))


@workload(
    "read_chunks",
    f"""WITH {REWRITTEN} SELECT printf('%d_chunk_%04d', document_id, chunk_index) AS chunk_id, md5(text) AS text_md5
FROM chunks WHERE document_id IN (SELECT item_id * 3 FROM benchmark)""",
)
def read_chunks(spark, sf_dir):
    found = kb.chunks_in_order(written_tables(spark, sf_dir)["chunks"], asked_ids(spark, sf_dir))
    return found.select("chunk_id", F.md5("text").alias("text_md5"))


@workload(
    "read_embeddings",
    f"""WITH {REWRITTEN} SELECT printf('%d_chunk_%04d', document_id, chunk_index) AS chunk_id, 64::INT AS dimensions,
  (SELECT count(*) FROM chunks) AS n_all FROM chunks WHERE document_id IN (SELECT item_id * 3 FROM benchmark)""",
)
def read_embeddings(spark, sf_dir):
    held = written_tables(spark, sf_dir)["embeddings"]
    found = kb.rows_of(held, asked_ids(spark, sf_dir))
    return found.select("chunk_id", "dimensions", F.lit(held.count()).cast("long").alias("n_all"))


# --- the editorial view ----------------------------------------------------------


def part(name: str, key: str, value: str) -> str:
    return f"SELECT '{name}' AS part, {key} AS key, round({value}, 6)::DOUBLE AS value FROM ({SQL[EDITORIAL[name]]})"


EDITORIAL = {
    "figures": "editorial_digest", "top_story": "top_story", "breaking": "breaking", "themes": "themes",
    "controversies": "controversies_by_topic", "controversial_papers": "controversial_papers",
}
# Every paper has its source as its one topic here.
MERGED = f"""SELECT 'merged_topics' AS part, source AS key, n::DOUBLE AS value FROM (
  WITH {PAPERS} SELECT source, count(*) AS n, min(seq) AS first FROM papers GROUP BY source HAVING count(*) > 1 ORDER BY first LIMIT 3)"""


@workload(
    "editorial_tables",
    " UNION ALL ".join(
        [
            part("figures", "section || '/' || position", "value"),
            part("top_story", "seq::VARCHAR", "story_score"),
            part("breaking", "seq::VARCHAR", "story_score"),
            part("themes", "theme || '/' || momentum", "paper_count"),
            part("controversies", "topic || '/' || score", "n_pairs"),
            part("controversial_papers", "topic || '/' || seq", "max_score"),
            MERGED,
        ]
    ),
)
def editorial_tables(spark, sf_dir):
    """All tables of the plan in one long form."""
    found = editorial(
        papers(spark, sf_dir),
        story=digests.STORY_WORDS,
        theme_words={"dictionary": digests.THEME_WORDS, "emerging": ("North",)},
        conflicts={"patterns": digests.PATTERNS, "directions": digests.DIRECTIONS},
        breaking_words={"threshold": 0.613, "words": digests.URGENT},
    )
    pairs = found["controversies"].groupBy("topic", F.round("score", 6).alias("score")).agg(F.sum("n_pairs").alias("n"))
    joined = lambda *cols: F.concat_ws("/", *cols)
    parts = {
        "figures": (found["figures"], joined("section", "position"), "value"),
        "top_story": (found["top_story"], F.col("seq").cast("string"), "story_score"),
        "breaking": (found["breaking"], F.col("seq").cast("string"), "story_score"),
        "themes": (found["themes"], joined("theme", "momentum"), "paper_count"),
        "merged_topics": (found["merged_topics"], F.col("topic"), "paper_count"),
        "controversies": (pairs, joined("topic", "score"), "n"),
        "controversial_papers": (found["controversial_papers"], joined("topic", "seq"), "max_score"),
    }
    out = None
    for name, (frame, key, value) in parts.items():
        rows = frame.select(F.lit(name).alias("part"), key.alias("key"), F.round(F.col(value).cast("double"), 6).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- SQL functions ---------------------------------------------------------------


@workload(
    "sql_functions",
    f"""WITH {PAPERS}, w AS (SELECT seq, list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda x: x <> '') AS w, title, abstract, doi, lang FROM papers),
s AS (SELECT *, unnest(range(0, greatest(len(w), 1), 6)) AS start FROM w)
SELECT seq, (start / 6)::INT AS chunk_index, array_to_string(list_slice(w, start + 1, start + 8), ' ') AS chunk,
  {NORM.format('title')} AS normalized,
  CASE WHEN doi IS NOT NULL THEN lower(doi) ELSE 'title:' || trim(lower(title)) END AS article_id, 1.0::DOUBLE AS same
FROM s""",
)
def sql_functions(spark, sf_dir):
    """The functions called from SQL text: titles cut into windows of 8 words, 2 of them shared."""
    register_sql_functions(spark)
    papers(spark, sf_dir).select("seq", "title", "abstract", "doi").createOrReplaceTempView("papers_for_sql")
    return spark.sql(
        """SELECT p.seq, c.chunk_index, c.chunk, p.normalized, p.article_id, p.same
           FROM (SELECT seq, title, normalize_title(title) AS normalized,
                        derive_id(doi, CAST(NULL AS STRING), CAST(NULL AS STRING), title) AS article_id,
                        round(cosine(array(1D, 2D, CAST(seq AS DOUBLE)), array(1D, 2D, CAST(seq AS DOUBLE))), 6) AS same
                 FROM papers_for_sql) p, LATERAL chunk_text(p.title, 8, 2) c"""
    )
