import math
import zlib
from collections import Counter

import numpy as np
import pytest

from paperlake.llm import language_id as L
from paperlake.llm.queries import QUERIES
from tests.llm.conftest import MIDDLE


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, MIDDLE).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    apart = [r.lang_pred == truth[r.doc_id].lang for r in rows if r.held_out]
    assert np.mean(apart) >= 0.98
    assert np.mean([r.accepted for r in rows if r.held_out]) >= 0.9


def kneser_ney(texts, gram, letters):
    """log P of the last character of a 4-gram, from the definition."""
    padded = []
    for t in texts:
        kept = []
        for c in t.lower():
            if c.isalpha():
                kept.append(c)
            elif kept and kept[-1] != " ":
                kept.append(" ")
        padded.append("   " + "".join(kept))
    counts = {4: Counter(p[i : i + 4] for p in padded for i in range(len(p) - 3))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = 1 / (letters + 1)
    for k in (1, 2, 3, 4):
        g = gram[4 - k :]
        n1, n2 = (sum(v == n for v in counts[k].values()) for n in (1, 2))
        d = min(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.95)
        same = {x: v for x, v in counts[k].items() if x[:-1] == g[:-1]}
        if same:
            p = max(counts[k][g] - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * p
        assert p > 0
    return math.log(p)


def test_probabilities_follow_the_definition(spark):
    texts = {"a": ["the cat sat, the mat!", "A hat."], "b": ["le chat été", "où est le lait? là"]}
    df = spark.createDataFrame([(t, lang) for lang, some in texts.items() for t in some], "text string, lang string")
    model = L.train(df)
    assert model.langs == ["a", "b"]
    grams = ["   t", "the ", " cat", "at s", "the c"[1:], "e ca", " cha", "été ", "zat ", "aaaa"]
    letters = len({c for some in texts.values() for t in some for c in t.lower() if c.isalpha()} | {" "})
    columns = [np.array([ord(g[k]) for g in grams], dtype=np.uint64) for k in range(4)]
    got = model.log_probabilities(columns)
    for i, g in enumerate(grams):
        for j, lang in enumerate(model.langs):
            if all(any(c in t.lower() or c == " " for t in texts[lang]) for c in g):
                assert got[i, j] == pytest.approx(kneser_ney(texts[lang], g, letters), abs=1e-5), (g, lang)


def test_characters_of_texts():
    codes, first = L.characters(["Ab, 1c", "", "--", "É!", "x"])
    parts = ["".join(map(chr, codes[a:b])) for a, b in zip(first[:-1], first[1:])]
    assert parts == ["ab c", "", "", "é ", "x"]


def test_nulls_repeats_clashes_and_empty_tables(spark):
    train = spark.createDataFrame([("hello there world", "en"), ("bonjour le monde", "fr"), (None, "de"), ("x", None)], "text string, lang string")
    model = L.train(train)
    assert model.langs == ["en", "fr"]
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 !?", 0), (4, "hello", 0), (4, "hello", 0), (5, "monde " * 5000, 0)], "doc_id long, text string, score int")
    got = sorted((r.doc_id, r.lang_pred, r.score > 0) for r in L.predict(df, model).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (5, "fr", True)]
    assert L.predict(df.limit(0), model).count() == 0
    nothing = L.train(train.limit(0))
    assert {r.lang_pred for r in L.predict(df, nothing).collect()} == {"und"}
    one = L.train(train.where("lang = 'en'"))
    assert [(r.lang_pred, r.score) for r in L.predict(df.where("doc_id = 5"), one).collect()] == [("en", 1.0)]


def test_a_hot_language_takes_no_grams_from_a_small_one(spark):
    """More than a million distinct 4-grams of one language; each of the other occurs once."""
    r = np.random.default_rng(1)
    hot = [("".join(map(chr, r.integers(0x4E00, 0x9000, 50_000))), "hot") for _ in range(24)]
    small = "quick brown foxes jump over lazy dogs"
    model = L.train(spark.createDataFrame([*hot, (small, "small")], "text string, lang string").repartition(8))
    padded = "   " + small
    assert len(model.grams[1][3][0]) == len({padded[k : k + 4] for k in range(len(small))})
    assert len(model.grams[0][3][0]) > 1_000_000


def test_calibration_sees_every_language_of_an_ordered_table(spark):
    """A language of few letters comes first, one of many letters (more nats a character) last."""
    r = np.random.default_rng(2)
    text = lambda first, n: "".join(map(chr, first + r.integers(0, n, 300)))
    rows = [(k, text(97, 4), "low") for k in range(1200)] + [(k, text(0x4E00, 500), "high") for k in range(1200, 1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = L.train(df)
    assert model.accepted[0] > 2 * model.accepted[1]
    fresh = [(k, text(97, 4) if k % 2 else text(0x4E00, 500)) for k in range(200)]
    found = L.predict(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()
    assert all(x.lang_pred == ("low" if x.doc_id % 2 else "high") for x in found)
    assert sum(x.accepted for x in found) >= 195
    # held out: a text of the sample is not in the counts
    apart = L._with_apart(df.select("text", "lang")).where("apart").groupBy("lang").count().collect()
    assert {x.lang: x["count"] for x in apart} == {"low": 100, "high": 40}


def test_copies_are_gone_before_the_ranks(spark):
    """One text 100,000 times over is one row of its language's window."""
    df = spark.range(100_400).selectExpr("if(id < 100000, 'the same text', concat('text ', id)) text", "'en' lang").repartition(8)
    apart = L._with_apart(df)
    assert apart.where("apart").select("h").distinct().count() == 40
    plan = apart._jdf.queryExecution().toString()
    rows = df.select("lang", L.F.xxhash64("text").alias("h")).distinct().count()
    assert rows == 401 and "Window" not in plan  # the ranks were cut off before and reach the rows as a broadcast
