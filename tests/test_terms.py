"""Many terms over many texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlake.functions import automaton
from paperlake.functions.terms import match_terms
from paperlake.sources.search import institution_feed

DOCUMENTS = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.parametrize("seed,window", [(1, 1024), (2, 7), (3, 1)])
def test_automaton_finds_every_term(monkeypatch, seed, window):
    monkeypatch.setattr(automaton, "WINDOW", window)
    monkeypatch.setattr(automaton, "BATCH_BYTES", 500)
    r = random.Random(seed)
    letters = ("ab", "abcé😀", "aA ")[seed % 3]
    terms = list({"".join(r.choices(letters, k=r.randrange(1, 7))) for _ in range(60)}) + ["long " * 40]
    texts = ["".join(r.choices(letters, k=r.randrange(0, 60))) for _ in range(200)]
    texts += [None, "", "".join(r.choices(letters, k=5000)), "x " + "long " * 41]
    found = automaton.hits(automaton.build(pa.array(terms)), pa.array(texts, pa.string()))
    assert found.to_pylist() == [[k for k, t in enumerate(terms) if x and t in x] for x in texts]


def test_automaton_without_terms_or_texts():
    none = automaton.build(pa.array([], pa.string()))
    assert automaton.hits(none, pa.array(["a", None])).to_pylist() == [[], []]
    assert automaton.hits(automaton.build(pa.array(["a"])), pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("max_cells", [automaton.MAX_CELLS, 900])
def test_match_terms_with_all_columns(spark, max_cells):
    """By one broadcast automaton and by many shards of terms."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdeÉ", k=r.randrange(1, 5)))
    texts = [(k, " ".join(word() for _ in range(r.randrange(0, 30))) or None, [k, k]) for k in range(120)] + [(3, "Twice abc", [0])] * 2
    terms = [(word(), k) for k in range(150)] + [("abc", 900), ("ABC", 901), ("", 902), (None, 903), ("no such", 904)]
    left = spark.createDataFrame(texts, "seq long, text string, more array<int>").repartition(3)
    found = match_terms(left, spark.createDataFrame(terms, "term string, q long"), max_cells=max_cells)
    assert sorted(found.columns) == ["more", "q", "seq", "term", "text"]
    got = sorted((x.seq, x.text, tuple(x.more), x.term, x.q) for x in found.collect())
    assert got == sorted((s, t, tuple(m), w, q) for s, t, m in texts for w, q in terms if t and w and w.lower() in t.lower())


def test_fifty_thousand_terms(spark):
    """Hits alone leave the automaton; a sample of the texts is compared with plain containment."""
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", F.lower("text").alias("text"))
    words = docs.select(F.explode(F.split("text", r"\s+")).alias("term")).where("length(term) > 3").distinct()
    terms = words.orderBy(F.xxhash64("term"), "term").limit(50_000)
    found = match_terms(docs, terms).select("doc_id", "term")
    sample = {r.doc_id: r.text for r in docs.where("doc_id % 997 = 0").collect()}
    listed = [r.term for r in terms.collect()]
    got = {(r.doc_id, r.term) for r in found.where("doc_id % 997 = 0").collect()}
    assert len(listed) == 50_000 and got == {(k, w) for k, t in sample.items() for w in listed if w in t}


def test_institutions_from_a_frame(spark):
    rows = [(1, "t", "At Mayo Clinic", "", "s", None, ["A"]), (2, "t", "mayo", "", "s", None, ["B"]), (3, "t", "", "OSLO and mayo clinic", "s", "d", ["C"])]
    df = spark.createDataFrame(rows, "seq long, title string, abstract string, affiliation string, source string, doi string, authors array<string>")
    names = ["Mayo Clinic", "Oslo", "Nowhere"]
    frame = spark.createDataFrame([(n,) for n in names], "institution string")
    for given in (names, frame):
        items, people = institution_feed(df, given, ["t"])
        assert {(r.institution, r.seq) for r in items.collect()} == {("Mayo Clinic", 1), ("Mayo Clinic", 3), ("Oslo", 3)}
        assert {(r.institution, r.author) for r in people.collect()} == {("Mayo Clinic", "A"), ("Mayo Clinic", "C"), ("Oslo", "C")}


def test_no_terms_or_no_texts(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None)], "seq long, text string")
    terms = spark.createDataFrame([("a",)], "term string")
    assert match_terms(texts, terms.where("term = 'z'")).collect() == []
    assert match_terms(texts.where("seq > 5"), terms).collect() == []
    assert match_terms(texts, spark.createDataFrame([("",), (None,)], "term string"), max_cells=1).collect() == []
    assert [r.seq for r in match_terms(texts, terms, max_cells=1).collect()] == [1]
