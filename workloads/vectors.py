"""Vector search, retrieval contexts and similar documents over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.functions.vectors import cosine, l2norm
from paperlake.operators import graph_search, lexical, retrieval
from paperlake.operators.chunking import chunk_fixed
from paperlake.session import cut_lineage, is_small
from workloads.documents import FIXED
from workloads.registry import workload
from workloads.views import chunk_vectors, documents, table

# One query per label: the mean of all its vectors.
CENTROIDS = """
centroids AS (
  SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS q FROM (
    SELECT label, i, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
  GROUP BY label),
vectors AS (SELECT vec_id AS chunk_id, label::BIGINT AS document_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (
  SELECT query_id, chunk_id, document_id, round(greatest(list_cosine_similarity(q, v), 0), 12) AS score
  FROM centroids, vectors)"""


def centroids(spark, sf_dir):
    xs = chunk_vectors(spark, sf_dir).select("document_id", F.posexplode("embedding").alias("i", "x"))
    means = xs.groupBy("document_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("document_id").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("embedding")
    )


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored {})"""


@workload(
    "vector_search",
    f"""WITH {CENTROIDS}, {RANKED.format('')}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 10""",
)
def vector_search(spark, sf_dir):
    return rounded(retrieval.vector_search(centroids(spark, sf_dir), chunk_vectors(spark, sf_dir), 10))


@workload(
    "vector_search_filtered",
    f"""WITH {CENTROIDS}, {RANKED.format('WHERE document_id IN (1, 3, 5) AND score >= 0.2')}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 5""",
)
def vector_search_filtered(spark, sf_dir):
    found = retrieval.vector_search(
        centroids(spark, sf_dir), chunk_vectors(spark, sf_dir), 5, 0.2, where=F.col("document_id").isin(1, 3, 5)
    )
    return rounded(found)


@workload(
    "vector_search_distance",
    f"""WITH {CENTROIDS},
d AS (SELECT query_id, chunk_id, round(1 / (1 + list_distance(q, v)), 12) AS score FROM centroids, vectors),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM d)
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 10""",
)
def vector_search_distance(spark, sf_dir):
    found = retrieval.vector_search(centroids(spark, sf_dir), chunk_vectors(spark, sf_dir), 10, metric="l2")
    return rounded(found)


# Each vector lies in the partition of its most similar centroid; a query probes the three most similar ones.
PROBED = """
near AS (SELECT vectors.chunk_id, c.query_id AS key, row_number() OVER (PARTITION BY vectors.chunk_id
  ORDER BY round(greatest(list_cosine_similarity(c.q, vectors.v), 0), 12) DESC, c.query_id) AS r FROM vectors, centroids c),
probes AS (SELECT a.{asker} AS query_id, c.query_id AS key, row_number() OVER (PARTITION BY a.{asker}
  ORDER BY round(greatest(list_cosine_similarity(c.q, a.{vector}), 0), 12) DESC, c.query_id) AS r FROM {askers} a, centroids c),
scored_probes AS (
  SELECT p.query_id, v.chunk_id, round(greatest(list_cosine_similarity(a.{vector}, v.v), 0), 12) AS score
  FROM probes p JOIN near n ON n.key = p.key AND n.r = 1 AND p.r <= 3
  JOIN vectors v ON v.chunk_id = n.chunk_id JOIN {askers} a ON a.{asker} = p.query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored_probes)"""


@workload(
    "vector_search_approx",
    f"""WITH {CENTROIDS}, {PROBED.format(asker='query_id', vector='q', askers='centroids')}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 10""",
)
def vector_search_approx(spark, sf_dir):
    """Label means as queries and as centroids."""
    means = centroids(spark, sf_dir)
    found = retrieval.vector_search_approx(
        means, chunk_vectors(spark, sf_dir), 10, n_probe=3, centroids=means.withColumnRenamed("query_id", "centroid_id")
    )
    return rounded(found)


@workload(
    "nearest_in_partitions",
    f"""WITH {CENTROIDS}, {PROBED.format(asker='chunk_id', vector='v', askers='vectors')}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 3""",
)
def nearest_in_partitions(spark, sf_dir):
    """Every vector as a query, within the partitions of its three nearest centroids."""
    vectors = chunk_vectors(spark, sf_dir)
    table = centroids(spark, sf_dir).withColumnRenamed("query_id", "centroid_id")
    asked = vectors.select(F.col("chunk_id").alias("query_id"), "embedding")
    found = retrieval.vector_search_approx(asked, vectors, 3, n_probe=3, centroids=table, shard_rows=40)
    return rounded(found)


@workload(
    "vector_search_graph",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(greatest(list_cosine_similarity(q.v, c.v), 0), 12) AS score FROM v q, v c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s)
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 10""",
)
def vector_search_graph(spark, sf_dir):
    """Every vector as a query through the graph; so few vectors are all found, of more some may be missed."""
    vectors = chunk_vectors(spark, sf_dir)
    asked = vectors.select(F.col("chunk_id").alias("query_id"), "embedding")
    return rounded(graph_search.vector_search_graph(asked, vectors, 10))


@workload(
    "cosine_to_centroid",
    f"""WITH {CENTROIDS}
SELECT v.chunk_id, round(list_cosine_similarity(c.q, v.v), 6) AS similarity,
  round(list_aggregate(list_transform(v.v, lambda x: x / sqrt(list_inner_product(v.v, v.v))), 'sum'), 6) AS unit_sum
FROM vectors v JOIN centroids c ON c.query_id = v.document_id""",
)
def cosine_to_centroid(spark, sf_dir):
    own = centroids(spark, sf_dir).select(F.col("query_id").alias("document_id"), F.col("embedding").alias("q"))
    joined = chunk_vectors(spark, sf_dir).join(own, "document_id")
    unit_sum = F.aggregate(l2norm(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return joined.select(
        "chunk_id",
        F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"),
        F.round(unit_sum, 6).alias("unit_sum"),
    )


@workload(
    "enriched_hits",
    f"""WITH {CENTROIDS}, {RANKED.format('')}
SELECT query_id, rank, chunk_id, round(score, 6) AS score, r.document_id, t.text FROM ranked r
LEFT JOIN documents t ON t.doc_id = r.chunk_id WHERE rank <= 10""",
)
def enriched_hits(spark, sf_dir):
    return rounded(retrieval.enrich_hits(hits(spark, sf_dir, 10), text_chunks(spark, sf_dir)))


def text_chunks(spark, sf_dir):
    """Vectors with the text of the document of the same number."""
    texts = documents(spark, sf_dir).select(F.col("document_id").alias("chunk_id"), "text")
    return chunk_vectors(spark, sf_dir).join(texts, "chunk_id", "left")


def hits(spark, sf_dir, k):
    return retrieval.vector_search(centroids(spark, sf_dir), chunk_vectors(spark, sf_dir), k)


@workload(
    "rag_context",
    f"""WITH {CENTROIDS}, {RANKED.format('')},
top AS (SELECT r.*, t.text FROM ranked r JOIN documents t ON t.doc_id = r.chunk_id WHERE rank <= 10 AND score >= 0.55),
g AS (SELECT query_id, string_agg('[' || document_id || '] ' || text || chr(10), chr(10) ORDER BY rank) AS context,
  array_to_string(list_sort(list(DISTINCT document_id)), '|') AS sources, avg(score) AS confidence, count(*) AS n FROM top GROUP BY query_id)
SELECT c.query_id, 'label ' || c.query_id AS question,
  coalesce(context, 'No relevant documents found to answer the question.') AS context, coalesce(sources, '') AS sources,
  round(coalesce(confidence, 0), 6) AS confidence, coalesce(n, 0)::BIGINT AS n_chunks
FROM centroids c LEFT JOIN g USING (query_id)""",
)
def rag_context(spark, sf_dir):
    queries = centroids(spark, sf_dir).withColumn("question", F.concat(F.lit("label "), "query_id"))
    found = retrieval.vector_search(queries, chunk_vectors(spark, sf_dir), 10, 0.55)
    context = retrieval.rag_context(
        queries.select("query_id", "question"), retrieval.enrich_hits(found, text_chunks(spark, sf_dir))
    )
    return context.withColumn("sources", F.array_join("sources", "|")).withColumn("confidence", F.round("confidence", 6))


SIMILAR = """
firsts AS (SELECT label AS document_id, vec_id, embedding FROM embeddings),
q AS (SELECT document_id AS query_id, list(x ORDER BY i) AS q FROM (
  SELECT document_id, i, avg(x::DOUBLE) AS x FROM (
    SELECT document_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM firsts) GROUP BY document_id, i)
  GROUP BY document_id),
s AS (SELECT q.query_id, e.vec_id AS chunk_id, e.label AS document_id,
  round(greatest(list_cosine_similarity(q.q, e.embedding::DOUBLE[]), 0), 12) AS score FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s)"""


@workload(
    "similar_documents",
    f"""WITH {SIMILAR}
SELECT query_id::BIGINT AS query_id, document_id::BIGINT AS similar_document_id, round(max(score), 6) AS score, min(rank)::INT AS first_rank
FROM r WHERE rank <= 10 GROUP BY query_id, document_id""",
)
def similar_documents(spark, sf_dir):
    chunks = chunk_vectors(spark, sf_dir)
    return rounded(retrieval.similar_documents(chunks, chunks.select("document_id").distinct()))


# BM25 over all documents, by the words of a question.
BM25 = r"""
words AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda w: w <> '') AS ws FROM documents),
held AS (SELECT chunk_id, ws, len(ws) AS length FROM words WHERE len(ws) > 0),
totals AS (SELECT count(*) AS n, avg(length) AS mean FROM held),
tf AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, length, unnest(ws) AS term FROM held) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, totals GROUP BY term),
asked AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(question), '[^\pL\pN]+'), lambda w: w <> '')) AS term FROM questions),
bm25 AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 12) AS score
  FROM asked JOIN tf USING (term) JOIN idf USING (term), totals GROUP BY query_id, chunk_id),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM bm25)"""


@workload(
    "lexical_search",
    f"""WITH questions AS (SELECT item_id AS query_id, text AS question FROM benchmark), {BM25}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM lexical WHERE rank <= 10""",
)
def lexical_search(spark, sf_dir):
    """Every benchmark item as a question to all documents."""
    index = lexical.build_index(documents(spark, sf_dir).withColumnRenamed("document_id", "chunk_id"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return rounded(lexical.lexical_search(asked, index, 10))


@workload(
    "hybrid_answers",
    f"""WITH {CENTROIDS}, {RANKED.format('')},
questions AS (SELECT f.query_id, split_part(d.text, chr(10), 1) AS question FROM (
  SELECT label::BIGINT AS query_id, min(vec_id) AS first FROM embeddings GROUP BY label) f JOIN documents d ON d.doc_id = f.first), {BM25},
v AS (SELECT query_id, chunk_id, round(score, 6) AS score FROM ranked WHERE rank <= 20),
l AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS score FROM lexical WHERE rank <= 20),
joint AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id,
  round(0.5 * coalesce(v.score, 0) + 0.5 * coalesce(l.score, 0), 9) AS score
  FROM v FULL JOIN l ON v.query_id = l.query_id AND v.chunk_id = l.chunk_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM joint)
SELECT b.query_id, b.rank, b.chunk_id, round(b.score, 6) AS score, d.text FROM best b LEFT JOIN documents d ON d.doc_id = b.chunk_id WHERE rank <= 10""",
)
def hybrid_answers(spark, sf_dir):
    """Label means and the title of a label's first document, as vector and words of one question."""
    texts = documents(spark, sf_dir).withColumnRenamed("document_id", "chunk_id")
    first = chunk_vectors(spark, sf_dir).groupBy(F.col("document_id").alias("query_id")).agg(F.min("chunk_id").alias("chunk_id"))
    asked = texts.join(F.broadcast(first) if is_small(first) else first, "chunk_id").select("query_id", F.substring_index("text", "\n", 1).alias("question"))
    words = lexical.normalised(lexical.lexical_search(asked, lexical.build_index(texts), 20))
    near = rounded(hits(spark, sf_dir, 20))
    found = cut_lineage(rounded(retrieval.hybrid_search(near, words, 0.5, 10)))
    held = found.select("chunk_id").distinct()
    wanted = texts.join(F.broadcast(held) if is_small(held) else held, "chunk_id", "left_semi")  # few texts move
    return found.join(wanted, "chunk_id", "left")


@workload(
    "summary_context",
    f"""WITH {FIXED} SELECT document_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS context_md5,
  count(*) AS n_chunks FROM chunks GROUP BY document_id""",
)
def summary_context(spark, sf_dir):
    chunks = chunk_fixed(documents(spark, sf_dir))
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    context = retrieval.summary_context(chunks).select("document_id", F.md5("context").alias("context_md5"))
    return context.join(counts, "document_id")


@workload(
    "similar_context",
    f"""WITH {SIMILAR},
texts AS (SELECT e.label AS document_id, e.vec_id, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.text <> ''),
src AS (SELECT document_id, string_agg(text, chr(10) ORDER BY vec_id) AS t FROM texts GROUP BY document_id),
rel AS (SELECT r.query_id AS document_id, string_agg('- ' || d.text, chr(10) ORDER BY r.rank) AS t
  FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.rank <= 10 GROUP BY r.query_id)
SELECT src.document_id::BIGINT AS document_id, md5(src.t) AS source_md5, coalesce(rel.t, '') AS related
FROM src LEFT JOIN rel USING (document_id)""",
)
def similar_context(spark, sf_dir):
    vectors = chunk_vectors(spark, sf_dir)
    queries = retrieval.document_queries(vectors, vectors.select("document_id").distinct())
    found = retrieval.enrich_hits(retrieval.vector_search(queries, vectors, 10), text_chunks(spark, sf_dir))
    near = found.where(F.col("text").isNotNull()).select(F.col("query_id").alias("document_id"), "rank", "text")
    context = retrieval.similar_context(text_chunks(spark, sf_dir), near)
    return context.select("document_id", F.md5("source_text").alias("source_md5"), "related")


@workload(
    "embedded_chunks",
    f"""WITH {FIXED} SELECT printf('%d_chunk_%04d', document_id, chunk_index) AS chunk_id, 64::INT AS dimensions,
  1.0::DOUBLE AS length FROM chunks""",
)
def embedded_chunks(spark, sf_dir):
    """Every chunk has one vector of unit length."""
    chunks = retrieval.embed(chunk_fixed(documents(spark, sf_dir)))
    length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return chunks.select("chunk_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(length), 6).alias("length"))
