import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.functions.sql import register_sql_functions
from paperlake.operators.retrieval import (
    _shards_of, choose_centroids, embed, enrich_hits, hybrid_search, rag_context, similar_documents, summary_context, vector_search, vector_search_approx,
)
from paperlake.plans.answers import answer_contexts
from paperlake.plans.ingest import index_documents, ingest_pages

VECTORS = "chunk_id long, document_id string, embedding array<float>"


def random_vectors(n, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, f"d{i % 5}", [float(x) for x in rng.normal(size=dims)]) for i in range(n)]


def brute(queries, vectors, k, threshold=0.0):
    out = {}
    for q, _, v in queries:
        a = np.array(v, dtype=np.float32).astype(float)
        scored = []
        for c, _, w in vectors:
            b = np.array(w, dtype=np.float32).astype(float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            s = max(0.0, float(a @ b / n)) if n else 0.0
            if s >= threshold:
                scored.append((-round(s, 12), c))
        out[q] = [c for _, c in sorted(scored)[:k]]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.mark.parametrize("shard_rows", [50_000, 70, 1])
def test_search_matches_brute_force(frame, shard_rows):
    vectors, queries = random_vectors(300), random_vectors(11, seed=1)
    vectors.append((300, "zero", [0.0] * 8))
    vectors.append((301, "copy", vectors[7][2]))
    vs = frame(vectors, VECTORS).repartition(5)
    qs = frame(queries, VECTORS).withColumnRenamed("chunk_id", "query_id")
    got = ranked(vector_search(qs, vs, 7, 0.1, shard_rows=shard_rows))
    assert got == brute(queries, vectors, 7, 0.1)


def test_filters_apply_before_the_cut(frame):
    vectors, queries = random_vectors(100), random_vectors(3, seed=2)
    qs = frame(queries, VECTORS).withColumnRenamed("chunk_id", "query_id")
    got = ranked(vector_search(qs, frame(vectors, VECTORS), 5, where=F.col("document_id") == "d2"))
    assert got == brute(queries, [v for v in vectors if v[1] == "d2"], 5)


def test_scores(frame):
    vs = frame([(1, "a", [1.0, 0.0]), (2, "b", [-1.0, 0.0]), (3, "c", [0.0, 0.0])], VECTORS)
    qs = frame([(0, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert {r.chunk_id: r.score for r in vector_search(qs, vs).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    l2 = {r.chunk_id: r.score for r in vector_search(qs, vs, metric="l2").collect()}
    assert l2[1] == pytest.approx(0.5) and l2[2] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        vector_search(qs, vs, metric="dot")


@pytest.mark.parametrize("shard_rows", [50_000, 15])
def test_approximate_search_prunes_and_finds_most(frame, shard_rows):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 8)) * 4
    rows = [(i, "d", [float(x) for x in middles[i % 12] + rng.normal(size=8)]) for i in range(600)]
    queries = [(i, "q", [x + 0.02 for x in v]) for i, _, v in rows[:60]]
    qs = frame(queries, VECTORS).withColumnRenamed("chunk_id", "query_id")
    vs = frame(rows, VECTORS)
    table = choose_centroids(vs, 24)
    exact = ranked(vector_search(qs, vs, 5))
    near = ranked(vector_search_approx(qs, vs, 5, n_probe=6, centroids=table, shard_rows=shard_rows))
    found = sum(len(set(exact[q]) & set(near.get(q, []))) for q in exact)
    assert found / sum(map(len, exact.values())) >= 0.9
    everything = ranked(vector_search_approx(qs, vs, 600, threshold=-1.0, n_probe=6, centroids=table, shard_rows=shard_rows))
    assert sum(map(len, everything.values())) <= 60 * 600 / 3  # candidates are a third of all pairs at most
    assert ranked(vector_search_approx(qs, vs, 5, n_probe=24, centroids=table, shard_rows=shard_rows)) == exact


def test_contexts(frame):
    questions = frame([(1, "ear ache"), (2, "nothing")], "query_id long, question string")
    hits = frame([(1, 1, 10, 0.5), (1, 2, 11, 0.25)], "query_id long, rank int, chunk_id long, score double")
    chunks = frame([(10, "b", "ten"), (11, "a", "eleven")], "chunk_id long, document_id string, text string")
    one, two = rag_context(questions, enrich_hits(hits, chunks)).orderBy("query_id").collect()
    assert one.context == "[b] ten\n\n[a] eleven\n" and one.sources == ["a", "b"] and one.confidence == 0.375
    assert two.context.startswith("No relevant") and two.sources == [] and two.confidence == 0.0


def test_index_then_answer(frame):
    docs = frame(
        [(1, "the tympanic membrane vibrates with sound waves"), (2, "sleep apnea disturbs breathing during the night"), (3, None)],
        "document_id long, text string",
    )
    made = index_documents(docs)
    status = {r.document_id: (r.status, r.total_chunks) for r in made["documents"].collect()}
    assert status == {1: ("completed", 1), 2: ("completed", 1), 3: ("failed", 0)}
    number = F.col("document_id")
    chunks = made["chunks"].withColumn("chunk_id", number)
    vectors = made["embeddings"].withColumn("chunk_id", number)
    asked = frame([(1, "sleep apnea breathing")], "query_id long, question string")
    answer = answer_contexts(asked, chunks, vectors, k=1).collect()[0]
    assert answer.sources == [2] and 0 < answer.confidence <= 1


def test_embeddings_are_deterministic(frame):
    df = frame([("a b c",), ("c b a",), ("",)], "text string")
    first, second = [r.embedding for r in embed(df).collect()], [r.embedding for r in embed(df.repartition(3)).collect()]
    assert sorted(first) == sorted(second) and first[0] == first[1] and sum(first[2]) == 0
    with pytest.raises(ValueError):
        embed(df, embedder="nope")


def test_similar_documents(frame):
    rows = [(1, "a", 0, [1.0, 0.0]), (2, "a", 1, [0.9, 0.1]), (3, "b", 0, [1.0, 0.05]), (4, "c", 0, [0.0, 1.0])]
    chunks = frame(rows, "chunk_id long, document_id string, chunk_index int, embedding array<float>")
    ids = frame([("a",)], "document_id string")
    numbered = {"a": 1, "b": 2, "c": 3}
    as_number = lambda df: df.replace({k: str(v) for k, v in numbered.items()}, subset=["document_id"]).withColumn(
        "document_id", F.col("document_id").cast("long")
    )
    found = similar_documents(as_number(chunks), as_number(ids), k=3, include_self=False).collect()
    assert [r.similar_document_id for r in found] == [2]


def test_summary_and_hybrid(frame):
    chunks = frame([("d", 1, "two"), ("d", 0, "one")], "document_id string, chunk_index int, text string")
    assert summary_context(chunks).collect()[0].context == "one\n\ntwo"
    vector = frame([(1, 1, 0.9), (1, 2, 0.1)], "query_id long, chunk_id long, score double")
    lexical = frame([(1, 2, 1.0)], "query_id long, chunk_id long, score double")
    assert [r.chunk_id for r in hybrid_search(vector, lexical).collect()] == [2, 1]


def test_ingest_pages(frame):
    text = "Title line\nAbstract\nA long enough abstract for one chunk.\nMethods\nA long enough method for another one."
    pages = frame([("p", 1, text, 0)], "document_id string, page_number int, text string, n_images int")
    made = ingest_pages(pages)
    assert [r.section for r in made["chunks"].collect()] == ["Abstract", "Methods"]
    assert made["documents"].collect()[0].title == "Title line"


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql(
        "SELECT normalize_title('A, b. C!') t, derive_id('', '12', null, 'x') i, study_design('A Cohort study') d, "
        "cosine(array(1D, 0D), array(1D, 1D)) c, cosine(array(0D), array(1D)) z"
    ).first()
    assert (row.t, row.i, row.d, row.z) == ("a b c", "pmid:12", "cohort", 0.0) and row.c == pytest.approx(0.5**0.5)
    rows = spark.sql("SELECT c.* FROM (SELECT 'a b c d e' AS body) t, LATERAL chunk_text(t.body, 3, 1) c").collect()
    assert [(r.chunk_index, r.chunk) for r in rows] == [(0, "a b c"), (1, "c d e"), (2, "e")]


def test_queries_are_not_copied_to_every_small_shard(frame):
    vectors = frame([(i, [1.0], i % 2) for i in range(200)], "id long, embedding array<double>, key long")
    wanted = frame([(i, [1.0], 0) for i in range(100)] + [(i, [1.0], 1) for i in range(5)], "id long, embedding array<double>, key long")
    dealt, sent, shards = _shards_of(vectors, wanted, 10)
    # as many queries as vectors: one shard; five queries: ten shards
    assert shards == 11 and dealt.count() == 200 and sent.count() == 100 + 5 * 10
    assert dealt.groupBy("shard").count().count() == 11


def test_chunks_in_sql_split_a_text_once(spark):
    register_sql_functions(spark)
    found = spark.sql("SELECT k, c.* FROM (SELECT id k, repeat('a b ', int(id) * 5) t FROM range(3)) x, LATERAL chunk_text(x.t, 8, 2) c")
    assert [tuple(r) for r in found.orderBy("k", "chunk_index").collect()] == [
        (0, 0, ""), (1, 0, "a b a b a b a b"), (1, 1, "a b a b"),
        (2, 0, "a b a b a b a b"), (2, 1, "a b a b a b a b"), (2, 2, "a b a b a b a b"), (2, 3, "a b"),
    ]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
