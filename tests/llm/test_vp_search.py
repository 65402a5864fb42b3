import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import vp_search as V
from paperlake.llm.queries import QUERIES
from tests.llm.conftest import MIDDLE


def brute(rows, every, k):
    """{(query, rank): (id, distance)} over usable rows, distances summed in order in double precision."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, dtype=np.float64))
    size = max((len(v) for v in good.values()), key=lambda n: sum(len(v) == n for v in good.values()), default=0)
    good = {i: v for i, v in good.items() if len(v) == size}
    out = {}
    for q in good:
        if q % every == 0:
            others = [i for i in good if i != q]
            away = V.distances(np.array([good[i] for i in others]).reshape(len(others), -1), good[q]) if others else []
            for rank, (d, i) in enumerate(sorted(zip(away, others))[:k], start=1):
                out[(q, rank)] = (i, d)
    return out


def search(df, every, **how):
    found = V.nearest(df, F.col("vec_id") % every == 0, **how).collect()
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in QUERIES["op6_vp_search"](spark, MIDDLE).collect()}
    assert got == brute(rows, 100, 10)


@pytest.fixture
def vectors():
    random = np.random.default_rng(2)
    points = [random.normal(size=3).round(1).tolist() for _ in range(700)]  # many ties
    points += [[1.0, 1.0, 1.0]] * 300 + [[2.0, 0.0, 0.0]] * 150
    rows = [(k, p) for k, p in enumerate(points)]
    rows += [(5000, None), (5001, [0.0, 0.0, 0.0]), (5002, [None, 1.0, 2.0]), (5003, [float("nan"), 1.0, 2.0]), (5004, [float("inf"), 1.0, 1.0])]
    rows += [(5005, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (5006, []), (0, points[0]), (7, points[7])]
    return rows


@pytest.mark.parametrize("shard_rows,query_rows", [(20_000, 4_000), (100, 7), (1, 50)])
def test_exact_search_with_ties(spark, vectors, shard_rows, query_rows):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    if shard_rows == 1:
        df = df.where("vec_id < 40 OR vec_id >= 5000 OR vec_id IS NULL")
        vectors = [v for v in vectors if v[0] is None or v[0] < 40 or v[0] >= 5000]
    assert search(df, 5, k=10, shard_rows=shard_rows, query_rows=query_rows) == brute(vectors, 5, 10)


def test_fewer_candidates_than_k_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {k: v[0] for k, v in search(df, 1, k=10).items()} == {(0, 1): 1, (1, 1): 0}
    assert search(df.limit(1), 1) == {} and search(df.limit(0), 1) == {}


def test_relaxed_pruning_scans_less_and_still_finds_most():
    random = np.random.default_rng(4)
    vectors = random.normal(size=(20_000, 6))
    queries, ids = vectors[:200], np.arange(200)
    tree = V.Tree(np.arange(len(vectors)), vectors)
    exact = V.Search(tree, ids, queries, 10, 1.0)
    scanned = []

    class Counting(V.Search):
        def _scan(self, rows, active):
            scanned.append(len(rows) * len(active))
            super()._scan(rows, active)

    Counting(tree, ids, queries, 10, 1.0)
    full, scanned[:] = sum(scanned), []
    relaxed = Counting(tree, ids, queries, 10, 0.5)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.found, relaxed.found)])
    assert full < 0.5 * 200 * len(vectors) and sum(scanned) < 0.6 * full and recall >= 0.9


def test_vectors_are_moved_once(spark):
    """However many blocks of queries there are, a shard's vectors are sent to its own copies only."""
    rows = [(k, [float(k % 17), float(k % 23)]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plan = V.nearest(df, F.col("vec_id") >= 0, shard_rows=10, query_rows=5)._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "block" not in plan
    assert search(df, 2, k=3, shard_rows=10, query_rows=5) == brute(rows, 2, 3)


def test_ids_with_several_vectors(spark):
    rows = [(1, [3.0, 1.0]), (1, [2.0, 9.0]), (2, [2.0, 8.0]), (3, [3.0, 2.0])]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        assert [v for _, v in sorted(search(df, 1, k=1).items())] == [(2, 1.0), (1, 1.0), (2, 37.0**0.5)]
