import datetime
import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from paperlake.operators.identity import (
    connected_components, identity_edges, jaccard_pairs, resolve_works, sequence_ratio, title_edges,
)
from paperlake.operators.merge import merge_works
from paperlake.plans.literature import search_works
from paperlake.sources.bibliographic import LISTS, SCALARS, load_articles, normalize_openalex
from workloads.works import dictionary_hits, raw_openalex

FIELDS = [c for c in SCALARS if c != "year"]
SCHEMA = (
    "seq long, year int, "
    + ", ".join(f"{c} string" for c in FIELDS)
    + ", "
    + ", ".join(f"{c} array<string>" for c in LISTS)
    + ", source string, provenance array<string>, retrieved_at timestamp"
)


def article(seq, source="pubmed", **values):
    row = {"seq": seq, "year": None, "source": source, "provenance": [source], "retrieved_at": None}
    row.update({c: None for c in FIELDS})
    row.update({c: [] for c in LISTS})
    row.update(values)
    return row


def articles(frame, *rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return frame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def works(df, **options):
    return {r.seq: r.work_id for r in resolve_works(df, **options).collect()}


def test_same_identifiers_are_one_work(frame):
    df = articles(
        frame,
        article(1, doi="10.1/X ", title="A"),
        article(2, doi="https://doi.org/10.1/x", title="B"),
        article(3, pmid="111", title="C"),
        article(4, pmid="111", title="D"),
        article(5, pmcid="PMC1", title="E"),
        article(6, pmcid="pmc1 ", title="F"),
        article(7, doi="10.1/b", title="Beta"),
    )
    assert works(df) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}
    assert works(df, canonical_doi=False)[2] == 2


def test_titles(frame):
    df = articles(
        frame,
        article(1, title="The rapid spread of viruses"),
        article(2, title="The rapid spread of viruses."),
        article(3, title="Work number 1 about cells"),
        article(4, title="Work number 1 about tissue"),
        article(5, title="work 0 1 x"),
        article(6, title="work 1 0 x"),
        article(7, title="Исследование"),
        article(8, title="Обзор"),
        article(9, title=None),
        article(10, title=""),
    )
    assert works(df) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10}


def test_links_chain_into_one_work_in_any_order(frame):
    rows = [article(1, doi="d1", title="A"), article(2, doi="d2", title="B"), article(3, doi="d1", pmid="9", title="C"),
            article(4, doi="d2", pmid="9", title="D")]
    assert set(works(articles(frame, *rows)).values()) == {1}
    assert set(works(articles(frame, *reversed(rows)).repartition(7)).values()) == {1}


def joined(edges):
    """The groups that edges join, as sets."""
    groups = []
    for a, b in edges:
        hit = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in hit] + [set().union({a, b}, *hit)]
    return {frozenset(g) for g in groups}


def test_similar_titles_match_brute_force(frame):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    titles = []
    for _ in range(60):
        base = rng.sample(vocabulary, rng.choice([3, 8, 9, 10, 11, 17, 18, 19, 20, 21, 25, 27, 28, 29, 30, 31, 33, 45]))
        titles.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.choice([1, 1, 2, 3])):
                i = rng.randrange(len(copy))
                action = rng.random()
                if action < 0.4:
                    copy[i] = rng.choice(vocabulary)
                elif action < 0.7:
                    copy.insert(i, rng.choice(vocabulary))
                elif len(copy) > 1:
                    copy.pop(i)
            titles.append(copy)
    titles = list(dict.fromkeys(" ".join(t) for t in titles))
    df = articles(frame, *[article(i, title=t) for i, t in enumerate(titles)])
    for threshold in (0.9, 0.95):
        jaccard, similar = set(), set()
        for i, a in enumerate(titles):
            for j in range(i + 1, len(titles)):
                x, y = set(a.split()), set(titles[j].split())
                if len(x & y) / len(x | y) >= threshold:
                    jaccard.add((i, j))
                    if SequenceMatcher(None, a, titles[j]).ratio() >= threshold:
                        similar.add((i, j))
        assert len(jaccard) > 30
        assert {(r.a, r.b) for r in jaccard_pairs(df, threshold).collect()} == jaccard
        edges = {(r.src, r.dst) for r in title_edges(df, threshold).collect()}
        assert edges <= similar and joined(edges) == joined(similar)


def test_template_titles_do_not_become_candidates(frame):
    from paperlake.functions.text import normalize_title
    from paperlake.operators.identity import title_candidates

    df = articles(frame, *[article(i, title=f"annual report of the national survey on ear health part {i}") for i in range(300)])
    titles = df.select(F.col("seq").alias("id"), normalize_title(F.col("title")).alias("norm"))
    tokens = titles.withColumn("tokens", F.array_distinct(F.split("norm", " ")))
    assert title_candidates(tokens, 0.9).count() == 0


def test_a_large_group_of_similar_titles_gives_a_star(frame):
    words = " ".join(f"word{i}" for i in range(24))
    df = articles(frame, *[article(i, title=f"{words} x{i}") for i in range(150)])
    assert title_edges(df).count() == 149
    assert set(works(df).values()) == {0}


def test_sequence_ratio_is_the_difflib_ratio():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 260)))
        b = a[: rng.randrange(len(a) + 1)] + "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))
        assert sequence_ratio(a, b, 0.9) == (SequenceMatcher(None, a, b).ratio() >= 0.9)


def test_components_match_union_find(frame):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)]
    edges += [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    loops = {n for e in edges for n in e} - {n for a, b in edges if a != b for n in (a, b)}
    expected = {n: find(n) for n in list(parent) if n not in loops}
    got = connected_components(frame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == expected


def test_hub_edges_are_stars(frame):
    df = articles(frame, *[article(i, doi="10.1/hot", title=f"t{i}") for i in range(200)])
    assert identity_edges(df).count() == 199


def test_merge_keeps_first_values_and_unions_lists(frame):
    older, newer = datetime.datetime(2020, 1, 1), datetime.datetime(2024, 1, 1)
    df = articles(
        frame,
        article(1, doi="10.1/x", title="T", authors=["Smith", "Smith"], keywords=["k1"], mesh_terms=["m1"], retrieved_at=older),
        article(2, "europepmc", doi="10.1/x", title="T2", authors=["Doe", "Smith"], keywords=["k2"], mesh_terms=["m2"],
                abstract="An abstract", retrieved_at=newer),
        article(3, "pubmed", doi="10.1/x", abstract="Late"),
    )
    merged = merge_works(resolve_works(df)).collect()
    assert len(merged) == 1
    m = merged[0]
    assert m.authors == ["Smith", "Smith", "Doe"]
    assert m.keywords == ["k1", "k2"] and m.mesh_terms == ["m1", "m2"]
    assert m.provenance == ["pubmed", "europepmc"]
    assert (m.title, m.abstract, m.retrieved_at, m.article_id, m.n_records) == ("T", "An abstract", newer, "10.1/x", 3)


def test_search_works(frame):
    df = articles(
        frame,
        article(1, doi="10.1/a", title="Tinnitus and sleep", year=2020),
        article(2, "europepmc", doi="10.1/a", title="Tinnitus and sleep", year=2020),
        article(3, title="Tinnitus old", year=1990),
        article(4, title="Other", year=2020),
    )
    found = search_works(df, {"q": "tinnitus OR vertigo"}, from_year=2000).collect()
    assert [(r.work_id, r.n_records) for r in found] == [(1, 2)]
    assert search_works(df, {"q": "tinnitus"}, source="europepmc").count() == 1


def test_load_articles(frame):
    pubmed = (
        '{"uid":"7","title":"T","pubdate":"Winter 2020-2021","source":"J","fulljournalname":"",'
        '"authors":[{"name":"A"},{"name":""}],"articleids":[{"idtype":"doi","value":"10/1"},{"idtype":"pmc","value":"PMC3"}],'
        '"abstracttext":[{"text":"x"},"y"],"keywords":["k"],"lang":["eng"],'
        '"fulltexturl":[{"content":"html","url":"h"},{"content":"pdf","url":"p"}]}'
    )
    europepmc = (
        '{"title":"T2","authorString":"A B, C D,","journalInfo":{"journal":{"title":"JJ","publisher":"P"},"volume":"1","year":2018},'
        '"pmid":"5","keywordList":["a",{"term":"b"},""],"meshTermList":{"meshTerm":[{"descriptorName":"m"}]},"pubType":"review"}'
    )
    openalex = (
        '{"id":"W1","title":"T3","publication_year":2021,"doi":"https://doi.org/10/3","ids":{"pmid":"5"},'
        '"abstract_inverted_index":{"b":[1],"a":[0,3],"c":[3]},"concepts":[{"display_name":"c"}],"mesh":[],'
        '"authorships":[{"author":{"display_name":"Z"}},{"author":{}}],"oa_locations":[{"pdf_url":null},{"pdf_url":"q"}]}'
    )
    one = lambda *texts: frame([(t,) for t in texts], "record string")
    good, bad, skipped = load_articles(
        {"pubmed": one(pubmed, "{oops"), "europepmc": one(europepmc), "openalex": one(openalex), "other": one("{}")}
    )
    rows = {r.source: r for r in good.collect()}
    p, e, o = rows["pubmed"], rows["europepmc"], rows["openalex"]
    assert (p.year, p.doi, p.pmid, p.pmcid, p.abstract, p.journal, p.language, p.pdf_url) == (
        2020, "10/1", "7", "PMC3", "x y", "J", "eng", "p"
    )
    assert p.authors == ["A"] and p.url == "https://pubmed.ncbi.nlm.nih.gov/7/"
    assert (e.journal, e.publisher, e.year, e.volume) == ("JJ", "P", 2018, "1")
    assert e.authors == ["A B", "C D"] and e.keywords == ["a", "b"] and e.mesh_terms == ["m"]
    assert e.publication_type == ["review"]
    assert o.abstract == "a b c" and o.mesh_terms == ["c"] and o.authors == ["Z"] and o.pdf_url == "q" and o.url == "W1"
    assert [(r.source, r.bad_record) for r in bad.collect()] == [("pubmed", "{oops")]
    assert skipped == {"other": "unknown source"}


def test_words_of_a_record_move_as_texts(spark, tmp_path):
    rows = [(1, "b a  b"), (2, ""), (3, None), (4, " x ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raw = raw_openalex(spark, str(tmp_path))
    found = normalize_openalex(raw).select("pmid", "abstract").collect()
    assert sorted(map(tuple, found)) == [("1", "b a b"), ("2", ""), ("4", "x")]
    assert raw._jdf.queryExecution().sparkPlan().toString().count("Generate") == 0


def test_hits_are_counted_without_sorting_them(spark, tmp_path):
    spark.createDataFrame([(1, "some WORDS here"), (2, "of other kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "otherwise words, here"), (1, "words"), (None, "kinds"), (3, "none"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = dictionary_hits(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 4, "here", "words"), (None, 1, "kind", "kind")]
    assert "SortAggregate" not in found._jdf.queryExecution().sparkPlan().toString()


def test_records_are_read_once(frame):
    """A filter on the parse does not repeat it, and with ``columns`` both frames come from one reading."""
    records = [('{"uid": "1", "title": "a", "articleids": [{"idtype": "doi", "value": "10.1/x"}]}',), ("{broken",), (None,)]
    raw = {"pubmed": frame(records, "record string"), "europepmc": frame([('{"title": "b", "doi": "10.1/y"}',)], "record string")}
    good, bad, skipped = load_articles({"pubmed": raw["pubmed"]})
    assert good.select("title", "doi")._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    some, quarantine, _ = load_articles(raw, columns=["source", "doi"])
    for kept in (some, quarantine):
        assert "from_json" not in kept._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(some.collect(), key=str) == [("europepmc", "10.1/y"), ("pubmed", "10.1/x"), ("pubmed", None)]
    assert [tuple(r) for r in quarantine.collect()] == [tuple(r) for r in bad.collect()] == [("pubmed", "{broken")]
    assert good.count() == 2 and not skipped


def test_an_index_holds_the_words_of_java_white_space(spark, tmp_path):
    """Only blanks are trimmed, and other spaces than those of Java's \\s stand inside words."""
    texts = [(1, " b a\tb "), (1, "a"), (2, "\né x \x0b \"q\\"), (3, ""), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {json.loads(r.record)["id"]: json.loads(r.record)["abstract_inverted_index"] for r in raw_openalex(spark, str(tmp_path)).collect()}
    assert found == {"W1": {"a": [0, 1], "b": [0, 2]}, "W2": {"": [0], "é x": [1], '"q\\': [2]}, "W3": {"": [0]}}
