import math
import random
import zlib

import numpy as np
import pyarrow as pa

from paperlake.llm import quality_classifier as Q
from paperlake.llm.queries import QUERIES
from paperlake.llm.textbytes import chunks
from tests.llm.conftest import MIDDLE


def featured(texts):
    out = {}
    for first, _, data, offsets in chunks(pa.array(texts, pa.string())):
        for row, bucket, value in zip(*(x.tolist() for x in Q.features(data, offsets))):
            out.setdefault(first + row, {})[bucket] = value
    return out


def test_query_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = QUERIES["op12_quality_classifier"](spark, MIDDLE).collect()
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    apart = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y, _ in apart if y == k] for k in (1, 0))
    assert len(bad) > 5 and sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(y == p for _, y, p in apart) >= 0.94 * len(apart)


def test_features():
    texts = ["One two  one;; two", "", None, "one one ONE", " \n\t", "Ünë,ünë", "one two one;; two"]
    found = featured(texts)
    assert sorted(found) == [0, 3, 5, 6] and found[0] == found[6]  # the case of ASCII letters does not count
    for values in found.values():
        assert math.isclose(sum(v * v for v in values.values()), 1)
    assert len(found[0]) == 3 + 4 and len(found[3]) == 2 + 2  # one, again; (one, again), (again, again)
    ratio = {round(v / min(found[0].values()), 6) for v in found[0].values()}
    assert ratio == {1.0, round(1 + math.log(2), 6)}  # "one" and "two" stand twice


def learned(spark, seed=1, n=200):
    r = random.Random(seed)
    good, bad = [f"g{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    docs, labels = [], []
    for k in range(n):
        own = good if k % 4 else bad
        docs.append((k, " ".join(r.choice(own) for _ in range(r.randrange(5, 60)))))
        labels.append((k, int(k % 4 > 0)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learning_is_independent_of_partitions_and_follows_the_updates(spark):
    docs, labels = learned(spark)
    df, marks = frames(spark, docs, labels)
    one = Q.train(df.coalesce(1), marks)
    two = Q.train(df.repartition(6), marks.repartition(3))
    assert np.array_equal(one.weights, two.weights) and one.constant == two.constant
    rows = Q.predict(df, one).collect()
    assert all((r.score > 0.5) == (r.doc_id % 4 > 0) for r in rows)
    found = featured([t for _, t in docs])
    for r in rows:
        x = sum(one.weights[b] * v for b, v in found[r.doc_id].items()) + one.constant
        assert math.isclose(r.score, 1 / (1 + math.exp(-x)), rel_tol=1e-6)
    places = {r.doc_id: r.p for r in df.selectExpr("doc_id", "xxhash64(doc_id) p").collect()}
    z, n, rate, l1, l2 = {}, {}, 1.0, 1e-4, 1e-3
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((1 + math.sqrt(n[i])) / rate + l2)
    for _ in range(Q.EPOCHS):
        for k in sorted(places, key=lambda k: (places[k], k)):
            x = {**{b: float(np.float32(v)) for b, v in found[k].items()}, "constant": 1.0}
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - labels[k][1]
            for i in x:
                step = (math.sqrt(n.get(i, 0) + (g * x[i]) ** 2) - math.sqrt(n.get(i, 0))) / rate
                z[i] = z.get(i, 0) + g * x[i] - step * w[i]
                n[i] = n.get(i, 0) + (g * x[i]) ** 2
    assert math.isclose(one.constant, weight("constant"), rel_tol=1e-6)
    assert all(math.isclose(one.weights[i], weight(i), rel_tol=1e-5, abs_tol=1e-7) for i in z if i != "constant")


def test_odd_rows(spark):
    docs, labels = learned(spark)
    more = [(1, docs[1][1]), (None, "g1 g2"), (900, None), (901, ""), (902, "g1 " * 200_000), (903, "b1 " + "b2 b3 " * 50_000)]
    marks = labels + [(3, 0), (4, None), (900, 1), (None, 0), (5, 7), (77777, 1), (1, 1)]
    df, marks = frames(spark, docs + more, marks)
    df = df.withColumn("score", Q.F.lit("clash"))
    model = Q.train(df, marks)
    rows = Q.predict(df, model).collect()
    assert len(rows) == len(docs) + len(more)
    of = {r.doc_id: r.score for r in rows}
    assert of[900] == of[901] == 1 / (1 + math.exp(-model.constant)) and of[902] > 0.5 > of[903]


def test_nothing_to_learn_from(spark):
    df, marks = frames(spark, [(1, "a b"), (2, None)], [])
    assert {r.score for r in Q.predict(df, Q.train(df, marks)).collect()} == {0.5}
    empty, marks = frames(spark, [], [(1, 1)])
    assert Q.predict(empty, Q.train(empty, marks)).collect() == []


def test_the_sample_is_bounded_and_spans_all_labels(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id % 5 > 0 as int) label")
    found = Q._sample(rows, 1000).collect()
    assert len(found) == 1000 and 700 < sum(r.label for r in found) < 900 and max(r.id for r in found) > 4500
