import datetime
import itertools
import random
import re

import pytest

from paperlake.fixed_values import CONTRADICTION_PATTERNS, OPPOSITE_DIRECTIONS, PERIOD_DAYS
from paperlake.operators.authors import author_rank, coauthor_edges, collaborators, emerging_authors
from paperlake.operators.editorial import (
    breaking, controversial_papers, controversies, controversy_groups, editorial_digest, merge_topics, themes, top_story, weekly,
)
from paperlake.operators.quality import first_seen, flag_quality, quality_filter
from paperlake.operators.ranking import importance, rank_items, trending
from paperlake.operators.tagging import enrich_items, topic_groups
from paperlake.operators.trends import new_developments, topic_trends
from paperlake.plans.digest import digest
from paperlake.plans.editorial import editorial

ITEM = "seq long, title string, abstract string, journal string, source string, publication_date date, evidence_level string"
AS_OF = datetime.date(2025, 6, 1)


def item(seq, title, abstract="", journal="", days=None, evidence=None):
    when = AS_OF - datetime.timedelta(days=days) if days is not None else None
    return (seq, title, abstract, journal, "pubmed", when, evidence)


def test_topics_designs_and_tags(frame):
    rows = enrich_items(
        frame(
            [
                item(1, "Cochlear implant outcomes", "A randomized screening of adults"),
                item(2, "Sleep medicine review"),
                item(3, "Nothing known"),
                item(4, "Otitis media and tinnitus: systematic review and meta-analysis"),
            ],
            ITEM,
        )
    ).orderBy("seq").collect()
    assert [r.topics for r in rows] == [["otology"], ["sleep_medicine"], ["general_ent"], ["otology"]]
    assert [r.study_design for r in rows] == ["rct", "narrative_review", None, "meta_analysis"]
    assert rows[0].tags == ["adult", "outcomes", "rct", "screening"]


def scores(frame, *rows):
    scored = importance(enrich_items(frame(list(rows), ITEM)), AS_OF)
    return [r.clinical_importance for r in scored.orderBy("seq").collect()]


def test_importance(frame):
    high, low = scores(
        frame, item(1, "Head and neck cancer meta-analysis", "", "The Lancet", 1, "A"), item(2, "Case report", "", "Other", 900, "D")
    )
    assert high > low and 0 <= low and high <= 1
    evidence = scores(frame, *[item(i, "x", evidence=e) for i, e in enumerate("ABCD")])
    assert evidence == sorted(evidence, reverse=True)
    new, old, undated = scores(frame, item(1, "x", days=0), item(2, "x", days=360), item(3, "x"))
    assert new > old and undated == pytest.approx(0.1 + 0.05 + 0.02 + 0.075 + 0.02, abs=0.006)
    top, other = scores(frame, item(1, "x", journal="JAMA Otolaryngology"), item(2, "x", journal="Sleep"))
    assert top > other


def test_ranking_is_stable(frame):
    df = frame([(1, 0.5), (2, 0.9), (3, 0.5)], "seq long, clinical_importance double")
    assert [r.seq for r in rank_items(df).collect()] == [2, 1, 3]
    assert [r.seq for r in trending(df, 2).collect()] == [2, 1]


def test_digest(frame):
    rows = [item(i, f"Tinnitus study {i}", days=i) for i in range(12)] + [item(50, "Rhinology trial", days=3)]
    made = digest(frame(rows, ITEM), "daily", AS_OF, limit=5)
    found = {r.article_seq for r in made["items"].collect()}
    assert found == {0, 1, 2, 3, 4, 50}  # five per query, within seven days
    whole = digest(frame(rows, ITEM), "daily", AS_OF)["items"]
    assert {r.article_seq for r in whole.collect()} == {*range(8), 50}
    assert PERIOD_DAYS["daily"] == 7
    topics = {r.topic: r.paper_count for r in made["topics"].collect()}
    assert topics == {"otology": 5, "rhinology": 1}
    everything = digest(frame(rows, ITEM), "daily", AS_OF, apply_period=False)
    assert everything["items"].count() == 13
    assert len(made["trending"].collect()) == 6


def test_topic_groups_list_first_titles(frame):
    df = frame([(i, f"t{i}", ["otology"]) for i in range(8)], "seq long, title string, topics array<string>")
    row = topic_groups(df).collect()[0]
    assert (row.paper_count, row.titles, row.display_name) == (8, [f"t{i}" for i in range(5)], "Otology")


def sequential_first_seen(rows):
    dois, titles, kept = set(), set(), []
    for seq, doi, title in rows:
        if doi:
            if doi in dois:
                continue
            dois.add(doi)
        if title.lower().strip() in titles:
            continue
        titles.add(title.lower().strip())
        kept.append(seq)
    return kept


def test_first_seen_is_the_sequential_rule(frame):
    rng = random.Random(0)
    rows = [(i, rng.choice(["", None, "a", "b", "c", "d"]), rng.choice(["X", "x ", "y", "z", "w"]) + str(rng.randrange(4))) for i in range(300)]
    got = first_seen(frame(rows, "seq long, doi string, title string").repartition(6))
    assert sorted(r.seq for r in got.collect()) == sequential_first_seen(rows)


def test_quality(frame):
    long = "x" * 60
    schema = "seq long, doi string, title string, abstract string, journal string"
    rows = [
        (1, "a", "Good", long, "The Laryngoscope"),
        (2, "a", "Same doi", long, "J"),
        (3, "", "RETRACTED: bad", long, "J"),
        (4, None, "Статья отозвано", long, "J"),
        (5, "", "Predatory", long, "International Journal of Scientific Things"),
        (6, "", "Meeting", long + " presented at the annual meeting", "J"),
        (7, "", "Short", "x", "J"),
        (8, "", "Good ", long, "J"),
    ]
    df = frame(rows, schema)
    assert [r.seq for r in quality_filter(df).collect()] == [1]
    reasons = {r.seq: r.reject_reason for r in flag_quality(df).collect()}
    assert reasons[4] == "retracted" and reasons[5] == "predatory" and reasons[6] == "conference_abstract" and reasons[7] == "low_quality"


def test_authors(frame):
    schema = "seq long, title string, authors array<string>"
    rows = [(1, "Otitis and voice", ["A", "B", ""]), (2, "Otitis in children", ["B", "A"]), (3, "Sinus", ["C", "A"]), (4, "x", None)]
    df = frame(rows, schema)
    top = author_rank(df).collect()
    assert [(r.author, r.paper_count) for r in top] == [("A", 3), ("B", 2), ("C", 1)]
    assert top[0].top_topics == ["otology", "laryngology", "pediatric"]
    assert [r.author for r in emerging_authors(df).collect()] == ["A", "B"]
    assert {(r.src, r.dst) for r in coauthor_edges(df).collect()} == {("A", "B"), ("B", "A"), ("C", "A")}
    assert {r.collaborator for r in collaborators(df, "B").collect()} == {"A"}


def test_trends(frame):
    rows = [(2025, "CRISPR ear", "")] * 7 + [(2024, "crispr", "")] * 2 + [(2025, "microbiome", "")] + [(2024, "microbiome", "")] * 4
    df = frame(rows, "year int, title string, abstract string")
    got = {r.topic: (r.growth_rate, r.momentum, r.emerging, r.paper_count) for r in topic_trends(df, 2025).collect()}
    assert got == {"crispr": (250.0, "exploding", True, 9), "microbiome": (-75.0, "stable", False, 5)}


def test_new_developments(frame):
    df = frame(
        [(1, "A novel suture technique", "with robotic surgery"), (2, "Novel hearing device", "organoid and mRNA vaccine")],
        "seq long, title string, abstract string",
    )
    got = {}
    for r in new_developments(df).orderBy("category", "rank").collect():
        got.setdefault(r.category, []).append(r.found)
    assert got["procedure"] == ["novel suture technique"] and got["device"] == ["Novel hearing device"]
    assert got["technique"] == ["robotic surgery"] and got["disease"] == ["organoid"]
    folded = {r.found for r in new_developments(df, fold_keywords=True).collect()}
    assert "mRNA vaccine" in folded


PAPER = ITEM.replace("source string, ", "") + ", authors array<string>, topics array<string>, clinical_importance double"


def paper(seq, title, abstract="", topics=("t",), score=0.5, evidence=None, journal="J", authors=("X",)):
    return (seq, title, abstract, journal, None, evidence, list(authors), list(topics), score)


def score_pair(a, b):
    total = 0.0
    for pattern, weight in CONTRADICTION_PATTERNS:
        if re.search(pattern, a) or re.search(pattern, b):
            total += weight
    for positive, negative in OPPOSITE_DIRECTIONS:
        has = [any(w in t for w in words) for t in (a, b) for words in (positive, negative)]
        if (has[0] and has[3]) or (has[1] and has[2]):
            total += 0.4
    return min(1.0, total)


def test_controversies_match_brute_force(frame):
    rng = random.Random(2)
    phrases = ["however", "no difference", "failed to", "controversial", "increase", "worse", "safe", "toxic", "effective", "plain", "спорный"]
    rows = [paper(i, " ".join(rng.sample(phrases, rng.randrange(4))), "", rng.sample(["a", "b", "c"], rng.randrange(1, 3))) for i in range(40)]
    df = frame(rows, PAPER)
    expected = {}
    for x, y in itertools.combinations(rows, 2):
        s = score_pair(f"{x[1]} {x[2]}".lower(), f"{y[1]} {y[2]}".lower())
        if s >= 0.5:
            for topic in set(x[7]) & set(y[7]):
                expected[(topic, x[0], y[0])] = round(s, 9)
    got = {(r.topic, r.seq_a, r.seq_b): round(r.score, 9) for r in controversies(df).collect()}
    assert got == expected and len(expected) > 50
    assert sum(r.n_pairs for r in controversy_groups(df).collect()) == len(expected)
    degree = {}
    for topic, a, b in expected:
        for n in (a, b):
            degree[(topic, n)] = degree.get((topic, n), 0) + 1
    assert {(r.topic, r.seq): r.n_conflicts for r in controversial_papers(df).collect()} == degree


def test_top_story_and_breaking(frame):
    df = frame([paper(1, "Plain", score=0.2), paper(2, "A novel first", "doctors should recommend", score=0.9, journal="The Lancet"),
                paper(3, "Urgent notice", score=0.0)], PAPER)
    best = top_story(df).collect()
    assert [r.seq for r in best] == [2] and best[0].story_score == pytest.approx(0.36 + 0.1 + 0.08 + 0.2)
    assert top_story(df.where("seq <> 2")).count() == 0
    assert {r.seq for r in breaking(df).collect()} == {2, 3}


def test_themes_and_merged_topics(frame):
    df = frame([paper(1, "Tinnitus one", topics=("b", "a")), paper(2, "tinnitus two", topics=("a",), authors=()), paper(3, "AI in ears", topics=("b", "c"), journal="")], PAPER)
    found = {r.theme: (r.paper_count, r.momentum, r.titles) for r in themes(df).collect()}
    assert found == {"Tinnitus": (2, "established", ["Tinnitus one", "tinnitus two"])}
    assert "Artificial Intelligence in ENT" in {r.theme for r in themes(df, fold_keywords=True).collect()}
    merged = merge_topics(df).collect()
    assert [(r.topic, r.paper_count, r.lead_authors, r.journals) for r in merged] == [("b", 2, "X; X", "J"), ("a", 2, "X; Unknown", "J")]


def test_editorial_figures(frame):
    df = frame([paper(i, "t" * 100, "a" * 650, score=i / 10, evidence="AC"[i % 2]) for i in range(10)], PAPER)
    rows = editorial_digest(df).collect()
    value = {r.section: r.value for r in rows if r.position == 0}
    assert value == {"papers_reviewed": 10.0, "high_evidence": 5.0, "reading_minutes": 5.0, "practice_changing_papers": 4.0}
    listed = lambda s: [r.seq for r in sorted(rows, key=lambda r: r.position) if r.section == s]
    assert listed("most_important") == [9] and listed("practice_changing") == [6, 7, 8, 9] and listed("practice_impact") == [0, 2]
    empty = {r.section: r.value for r in editorial_digest(df.limit(0)).collect()}
    assert empty["reading_minutes"] == 1.0
    assert weekly([df, df]).count() == 20
    assert set(editorial(df)) == {"figures", "top_story", "breaking", "themes", "merged_topics", "controversies", "controversial_papers"}
