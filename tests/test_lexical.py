"""BM25 over an index in blocks against scoring everything."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from paperlake.operators import lexical
from paperlake.operators.lexical import block_bounds, build_index, lexical_search, normalised, tokens


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(chunks, queries, k):
    held = {c: words(t) for c, t in chunks if words(t)}
    mean = sum(map(len, held.values())) / max(len(held), 1)
    df = collections.Counter(w for ws in held.values() for w in set(ws))
    out = {}
    for q, text in queries:
        scores = []
        for c, ws in held.items():
            tf = collections.Counter(ws)
            s = sum(
                math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                for w in set(words(text)) if tf[w]
            )
            if s:
                scores.append((-round(s, 9), c))
        if scores:
            out[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return out


def corpus(seed, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    text = lambda: " ".join(r.choices(vocabulary, weights, k=r.choice((3, 10, 40, 200))))
    chunks = [(k, text()) for k in range(n)] + [(9000, None), (9001, " .,! "), (9002, "Ünï-code w1; W1")]
    queries = [(q, " ".join(r.choices(vocabulary, k=r.randrange(1, 6)))) for q in range(25)]
    return chunks, queries + [(90, "nowhere"), (91, None), (92, ""), (93, "w0 w0 ÜNÏ"), (94, "w0")]


def result(frame):
    out = collections.defaultdict(list)
    for r in frame.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.chunk_id, round(r.score, 9)))
    return dict(out)


@pytest.mark.parametrize("seed,block_rows,k", [(1, 128, 10), (2, 8, 3), (3, 1, 5)])
def test_the_best_chunks_are_those_of_scoring_everything(frame, seed, block_rows, k):
    chunks, queries = corpus(seed)
    index = build_index(frame(chunks, "chunk_id long, text string").repartition(3), block_rows=block_rows)
    found = result(lexical_search(frame(queries, "query_id long, question string"), index, k))
    wanted = brute(chunks, queries, k)
    assert found.keys() == wanted.keys()
    for q in wanted:
        assert [c for c, _ in found[q]] == [c for c, _ in wanted[q]]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in wanted[q]], abs=1e-8)


def test_most_blocks_are_never_read(frame):
    """Bounds hold in every block, and blocks below the k-th best score are left out."""
    chunks, queries = corpus(5, n=1500)
    index = build_index(frame(chunks, "chunk_id long, text string"), block_rows=8)
    asked = frame([(q, w) for q, t in queries for w in set(words(t))], "query_id long, term string").join(index.terms.drop("df"), "term")
    bounds = block_bounds(asked, index).cache()
    scored, rest = lexical._first_blocks(asked, index, bounds, 3)
    every = lexical._scores(asked, index, bounds.select("query_id", "block")).groupBy("query_id").agg(F.max("score").alias("s"))
    top = bounds.groupBy("query_id").agg(F.max("bound").alias("b"))
    assert every.join(top, "query_id").where("s > b + 1e-9").count() == 0
    assert 0 < rest.count() < bounds.count() / 2


def test_a_frequent_term_has_many_rows(frame):
    index = build_index(frame([(k, "the same words") for k in range(600)], "chunk_id long, text string"), block_rows=50)
    sizes = [r.s for r in index.postings.where("term = 'the'").select(F.size("entries").alias("s")).collect()]
    assert sum(sizes) == 600 and max(sizes) < 150
    tied = result(lexical_search(frame([(1, "same")], "query_id long, question string"), index, 4))
    assert [c for c, _ in tied[1]] == [0, 1, 2, 3]


def test_nothing_indexed_or_asked(frame):
    empty = build_index(frame([], "chunk_id long, text string"))
    asked = frame([(1, "word")], "query_id long, question string")
    assert lexical_search(asked, empty).collect() == []
    index = build_index(frame([(1, "word")], "chunk_id long, text string"))
    assert lexical_search(frame([], "query_id long, question string"), index).collect() == []


def test_normalised_scores_and_tokens(frame):
    hits = normalised(frame([(1, 5, 4.0), (1, 6, 1.0), (2, 7, 0.5)], "query_id long, chunk_id long, score double"))
    assert sorted((r.chunk_id, r.score) for r in hits.collect()) == [(5, 1.0), (6, 0.25), (7, 1.0)]
    assert frame([("Été-2 x_y",)], "t string").select(tokens(F.col("t")).alias("w")).first().w == ["été", "2", "x", "y"]


def test_a_block_of_chunks_moves_once(frame):
    index = build_index(frame([(k, "a b b " + "c " * (k % 3)) for k in range(40)], "chunk_id long, text string"), block_rows=8)
    tf = {(e.chunk_id, r.term) for r in index.postings.collect() for e in r.entries}
    assert tf == {(k, t) for k in range(40) for t in ("a", "b", "c") if t != "c" or k % 3}
    twice = build_index(frame([(1, "a b b"), (1, "b a b"), (2, "a c")], "chunk_id long, text string"))
    assert sorted((r.term, len(r.entries)) for r in twice.postings.collect()) == [("a", 1), ("a", 1), ("b", 1), ("c", 1)]


def test_the_index_stays_where_it_is_for_few_words(spark, frame):
    index = build_index(frame([(k, f"word{k} other") for k in range(50)], "chunk_id long, text string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lexical_search(frame([(1, "word7")], "query_id long, question string"), index, 3)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "strategy=broadcast" in plan and [r.chunk_id for r in found.collect()] == [7]


def test_scores_of_few_queries_do_not_move(spark, frame, tmp_path):
    """Each task keeps the best chunks of its blocks; tables that were written and read again are searched alike."""
    chunks, queries = corpus(7)
    asked = frame(queries, "query_id long, question string")
    index = build_index(frame(chunks, "chunk_id long, text string").repartition(3), block_rows=16)
    found = lexical_search(asked, index, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the distinct words that are asked for
    index.postings.repartition(4).write.parquet(f"{tmp_path}/postings")
    index.terms.write.parquet(f"{tmp_path}/terms")
    again = lexical.LexicalIndex(spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/terms"))
    assert result(found) == result(lexical_search(asked, again, 5))
    wanted = brute(chunks, queries, 5)
    assert {q: [c for c, _ in hits] for q, hits in result(found).items()} == {q: [c for c, _ in hits] for q, hits in wanted.items()}


def test_many_queries_are_joined(frame, monkeypatch):
    chunks, queries = corpus(8, n=150)
    asked = frame(queries, "query_id long, question string")
    index = build_index(frame(chunks, "chunk_id long, text string"), block_rows=16)
    few = result(lexical_search(asked, index, 5))
    monkeypatch.setattr(lexical, "is_small", lambda df: False)
    assert result(lexical_search(asked, index, 5)) == few
