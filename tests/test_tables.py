import datetime
import random

import pytest
from pyspark.sql import functions as F

from paperlake.functions.text import contains_any, count_hits, matches_any
from paperlake.operators.guidelines import (
    guideline_keyword_search, keyword_recommendations, recommendations, split_guidelines, verify_citations,
)
from paperlake.operators.reports import order_statistics, run_report
from paperlake.plans.guidelines import ingest_guidelines
from paperlake.plans.ingest import index_documents
from paperlake.sources import knowledge_base as kb
from paperlake.sources.fulltext import audit_files, fulltext_candidates
from paperlake.sources.knowledge_base import upsert
from paperlake.sources.search import institution_feed, journal_feed, lookup, match_terms, term_search, topic_search
from paperlake.streaming.jobs import first_seen_stream, ingest_stream, period_counts, run_available

# Own wording, in the shape of a national guideline.
GUIDELINE = """Клинические рекомендации: отит

1. ДИАГНОСТИКА
Для диагностики рекомендуется проведение отоскопии (уровень доказательств B).

2. ЛЕЧЕНИЕ
Мы рекомендуем назначение антибиотика в первые сутки (уровень доказательств A).
Настоятельно рекомендуется посев отделяемого.
Не рекомендуется применение капель. На фоне терапии рекомендуется покой.
Препарат противопоказан детям до года. С осторожностью при беременности."""


def test_recommendations(frame):
    text = frame([("g", "Отит", GUIDELINE, 1)], "guideline_id string, title string, text string, seq long")
    made = ingest_guidelines(text)
    sections = made["sections"].collect()
    assert [s.heading for s in sections] == ["Клинические рекомендации: отит", "1. ДИАГНОСТИКА", "2. ЛЕЧЕНИЕ"]
    assert sections[0].content == "Клинические рекомендации: отит"
    recs = {r.text: r for r in made["recommendations"].collect()}
    strength = {t.split()[0]: r.strength for t, r in recs.items()}
    assert strength == {
        "проведение": "conditional", "назначение": "conditional", "посев": "strong", "применение": "not_recommended", "покой.": "conditional",
    }
    drug = recs["назначение антибиотика в первые сутки (уровень доказательств A)."]
    assert (drug.evidence_level, drug.pregnancy, drug.population) == ("A", "caution", "2. ЛЕЧЕНИЕ")
    assert drug.contraindications == ["детям до года"] and len(drug.text_hash) == 16
    cited = frame([("покой.",), ("что-то",)], "text string")
    checked = {r.text: (r.verified, r.confidence, r.source_id) for r in verify_citations(cited, made["registered"]).collect()}
    assert checked == {"покой.": (True, 1.0, "g"), "что-то": (False, 0.0, None)}
    asked = keyword_recommendations({"q": "Покой нужен"}, made["recommendations"]).collect()
    assert [r.text for r in asked] == ["покой."]
    found = guideline_keyword_search("отит", made["guidelines"], made["sections"], made["recommendations"]).collect()
    assert [(r.guideline_id, r.score) for r in found] == [("g", 15)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("We strongly recommend early treatment (evidence level A).", [("strong", "early treatment (evidence level A).", "A")]),
        ("We recommend rest. We do not recommend drops.", [("not_recommended", "drops.", "expert_opinion"), ("conditional", "rest.", "expert_opinion")]),
        ("Patients should not fly. Not recommended for infants.", [("not_recommended", "fly.", "expert_opinion"), ("not_recommended", "for infants.", "expert_opinion")]),
        ("A plain sentence.", []),
        ("", []),
    ],
)
def test_english_recommendations(frame, text, expected):
    df = frame([("g", 0, "h", text)], "guideline_id string, section_index int, heading string, content string")
    assert [(r.strength, r.text, r.evidence_level) for r in recommendations(df).orderBy("position").collect()] == expected


def test_split_keeps_single_line_blocks(frame):
    rows = split_guidelines(frame([("g", "One line\n\nHead\nBody\nMore")], "guideline_id string, text string")).collect()
    assert [(r.heading, r.content) for r in rows] == [("One line", "One line"), ("Head", "Body\nMore")]


def test_order_statistics_match_sorting(frame):
    rng = random.Random(4)
    rows = [("a", rng.choice([1.0, 2.5, rng.random() * 100])) for _ in range(500)] + [("b", 7.0)] * 9 + [("c", 1.0)]
    got = {r.k: (r.p50, r.p90, r.p95) for r in order_statistics(frame(rows, "k string, v double"), "k", "v", bins=16).collect()}
    for key in "abc":
        values = sorted(v for k, v in rows if k == key)
        n = len(values)
        assert got[key] == (values[int(n * 0.5)], values[int(n * 0.9)], values[int(n * 0.95)])


def test_run_report(frame):
    rows = [("index", True, 10.0, 3), ("index", False, 30.0, 0), ("search", True, 5.0, 0)]
    got = {r.stage: r for r in run_report(frame(rows, "stage string, ok boolean, ms double, chunk_count int")).collect()}
    assert (got["index"].success_rate_pct, got["index"].status, got["index"].p50) == (50.0, "partial", 30.0)
    assert got["search"].status == "completed"


def test_tables_of_documents(spark, frame, tmp_path):
    """The same changes as functions of frames and in tables of folders."""
    path = str(tmp_path / "kb")
    long = "these words are long enough to make a chunk of text"
    schema = "document_id string, text string"
    first = index_documents(frame([("a", long), ("b", long), ("c", long), ("b", long)], schema).distinct())
    again = index_documents(frame([("b", long + " again"), ("d", None)], schema))
    kb.write_tables(first, path, buckets=4)
    for _ in range(2):  # a write that is repeated changes nothing
        kb.put_documents(spark, path, again, buckets=4)
    held = {name: f.cache() for name, f in kb.indexed_over(first, again).items()}
    for tables in (held, kb.read_tables(spark, path)):
        assert {r.document_id for r in tables["documents"].collect()} == {"a", "b", "c", "d"}
        assert tables["embeddings"].count() == tables["chunks"].count() == 3
        assert kb.chunks_in_order(tables["chunks"], frame([("b",)], "document_id string")).collect()[0].text.endswith("again")
        assert kb.newest_of(tables["documents"], frame([("a",), ("z",)], "document_id string")).count() == 1
        left = kb.without_chunks(tables, frame([("c_chunk_0000",)], "chunk_id string"))
        assert {r.document_id for r in left["chunks"].collect()} == {"a", "b"} and left["documents"].count() == 4
    gone = frame([("a",), ("b",), ("c",)], "document_id string")
    kb.remove_documents(spark, path, gone, buckets=4)
    for tables in (kb.without_documents(held, gone), kb.read_tables(spark, path)):
        assert {r.document_id for r in tables["documents"].collect()} == {"d"}
    assert kb.without_documents(held, gone)["chunks"].count() == 0


def test_a_document_that_loses_its_chunks(spark, frame, tmp_path):
    """No row of a partition is left: it goes, rather than keep what it held."""
    path, schema = str(tmp_path / "kb"), "document_id string, text string"
    long = "these words are long enough to make a chunk of text"
    kb.write_tables(index_documents(frame([("a", long), ("b", long)], schema)), path, buckets=50)
    kb.put_documents(spark, path, index_documents(frame([("a", None)], schema)), buckets=50)
    tables = kb.read_tables(spark, path)
    assert {r.document_id for r in tables["chunks"].collect()} == {"b"} and tables["documents"].count() == 2


def test_upsert_takes_the_last_update(frame):
    table = frame([(1, "old"), (2, "old")], "k long, v string")
    updates = frame([(2, "first", 0), (2, "last", 1), (3, "new", 0)], "k long, v string, n int")
    assert {(r.k, r.v) for r in upsert(table, updates, ["k"], "n").collect()} == {(1, "old"), (2, "last"), (3, "new")}


ARTICLE = "seq long, title string, abstract string, affiliation string, source string, doi string, pmid string, pmcid string, authors array<string>"


def test_search(frame):
    rows = [(i, f"Tinnitus {i}", "", "Mayo Clinic", "pubmed", f"10/{i % 2}" if i < 4 else None, str(i), f"PMC{i}", [f"A{i}"]) for i in range(8)]
    df = frame(rows, ARTICLE)
    assert [r.seq for r in term_search(df, {"q": "TINNITUS OR x"}, 3).collect()] == [0, 1, 2]
    assert term_search(df, {"q": "tinnitus"}, 500).count() == 8
    assert term_search(df, {"q": "tinnitus"}).count() == 8
    many = frame([(100 + i, "Tinnitus", "", "", "pubmed", None, None, None, []) for i in range(700)], ARTICLE)
    assert term_search(many, {"q": "tinnitus"}, 500).count() == 500
    assert topic_search(df, {"t": ["none", "tinnitus", "tinnitus 1"]}).select("query_id").distinct().count() == 2
    found = {r.identifier: r.seq for r in lookup(df, ["https://doi.org/10/1", "pmc3", "5", "tinnitus 6"]).collect()}
    assert found == {"https://doi.org/10/1": 1, "pmc3": 3, "5": 5, "tinnitus 6": 6}
    items, people = institution_feed(df, ["Mayo Clinic"], ["tinnitus"], 6)
    assert [r.seq for r in items.orderBy("seq").collect()] == [0, 1, 4]
    assert {r.author for r in people.collect()} == {"A0", "A1", "A4"}


def test_a_report_counts_all_articles(frame):
    rows = [(i, "J", 2024) for i in range(11)]
    feed, report = journal_feed(frame(rows, "seq long, journal string, year int"), [("J", "0", 1.0), ("K", "1", 2.0)], 2024, limit=10)
    assert feed.count() == 10
    assert {r.journal: r.papers_this_period for r in report.collect()} == {"J": 11, "K": 0}


def test_thousands_of_keywords(frame):
    df = frame([(0, "about word4321 and more"), (1, "nothing here"), (2, None)], "seq long, text string")
    words = [f"word{k}" for k in range(5000)]
    got = {r.seq: (r.any, r.n) for r in df.select("seq", contains_any(F.col("text"), words).alias("any"), count_hits(F.col("text"), words).alias("n")).collect()}
    assert got[0] == (True, 4) and got[1] == (False, 0) and not got[2][0]
    assert df.where(matches_any(F.col("text"), [f"^about {w}$" for w in words] + ["^nothing"])).count() == 1


def test_match_terms_finds_every_occurrence(frame):
    texts = ["the cat sat", "Concatenate", "at", "", None, "a", "été x"]
    terms = ["cat", "at", "a", "THE CAT", "t", "", None, "zz", "été", "tenate"]
    df = frame(list(enumerate(texts)), "seq long, text string")
    got = {(r.seq, r.term) for r in match_terms(df, frame([(t,) for t in terms], "term string")).collect()}
    assert got == {(i, w) for i, t in enumerate(texts) for w in terms if t and w and w.lower() in t.lower()}


def test_fulltext_candidates(frame):
    schema = "article_id string, doi string, pmcid string, url string, pdf_url string"
    rows = [("a", "doi:10/1", "PMC7", "http://x", "http://x"), ("b", None, "", "http://y", None)]
    got = fulltext_candidates(frame(rows, schema)).orderBy("article_id", "rank").collect()
    assert [(r.article_id, r.resolver) for r in got] == [("a", "pmc")] * 3 + [("a", "doi"), ("a", "publisher"), ("b", "publisher")]
    assert got[3].url == "https://doi.org/10/1" and got[5].mime_type == "text/html"


def test_audit_files(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF-1", "b.pdf": b"%PDF-1", "c.pdf": b"<html>no</html>", "d.pdf": b"junk"}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in audit_files(spark, str(tmp_path)).collect()}
    assert rows["a.pdf"].problem is None and rows["a.pdf"].copies == 2 and not rows["a.pdf"].is_copy and rows["b.pdf"].is_copy
    assert rows["c.pdf"].problem == "html_page" and rows["d.pdf"].problem == "mime_type" and rows["d.pdf"].size == 4


def event_files(spark, frame, folder, per_trigger=1):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=6 * i), f"k{i % 3}") for i in range(120)]
    df = frame(rows, "n long, ts timestamp, doi string")
    df.repartitionByRange(3, "ts").write.parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def test_period_counts(spark, frame, tmp_path):
    # one batch: files of separate batches may come out of time order and count as late
    batch, stream = event_files(spark, frame, str(tmp_path / "in"), per_trigger=10)
    done = run_available(period_counts(stream, "doi", "7 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = batch.agg(F.max("ts") - F.expr("interval 1 day")).first()[0]
    expected = batch.groupBy(F.window("ts", "7 days").alias("w"), "doi").count().where(F.col("w.end") <= F.lit(closed))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(done.select("period_start", "doi", "n")) == as_set(expected.select("w.start", "doi", "count"))
    assert done.count() > 0


def test_first_seen_stream(spark, frame, tmp_path):
    _, stream = event_files(spark, frame, str(tmp_path / "in"))
    done = run_available(first_seen_stream(stream, delay="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.doi for r in done.collect()) == ["k0", "k1", "k2"]


def test_ingest_stream_resumes(spark, frame, tmp_path):
    long = "these words are long enough to make a chunk of text"
    source, path = str(tmp_path / "in"), str(tmp_path / "kb")

    def arrive(*ids):
        frame([(i, long) for i in ids], "document_id string, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("document_id string, text string").parquet(source)
        ingest_stream(stream, path, str(tmp_path / "cp"), buckets=3).awaitTermination()
        return {r.document_id for r in kb.read_tables(spark, path)["chunks"].collect()}

    assert arrive("a", "b") == {"a", "b"}
    assert arrive("b", "c") == {"a", "b", "c"}
