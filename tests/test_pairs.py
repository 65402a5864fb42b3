"""Pairs that are bounded by what is asked for: conflicting papers and co-authors."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators.authors import author_papers, coauthor_edges
from paperlake.operators.editorial import controversies, controversy_pairs

PATTERNS = ((r"contradict", 0.3), (r"however", 0.2), (r"no benefit", 0.4))
DIRECTIONS = ((("increase",), ("decrease",)),)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_the_strongest_pairs_of_each_topic(frame, k):
    r = random.Random(k)
    words = ["contradict", "however", "no benefit", "increase", "decrease", "plain"]
    rows = []
    for n in range(90):
        topics = r.sample(["a", "b", "c"], r.randrange(0, 3))
        rows.append((n * 7, f"T{n}", " ".join(r.sample(words, r.randrange(0, 4))), topics, [f"A{n}"] if n % 5 else []))
    df = frame(rows, "seq long, title string, abstract string, topics array<string>, authors array<string>").repartition(3)
    every = collections.defaultdict(list)
    for x in controversies(df, PATTERNS, DIRECTIONS).collect():
        every[x.topic].append((-round(x.score, 9), x.seq_a, x.seq_b, x.author_a, x.title_b))
    found = collections.defaultdict(list)
    for x in controversy_pairs(df, k, PATTERNS, DIRECTIONS).orderBy("topic", "rank").collect():
        found[x.topic].append((-x.score, x.seq_a, x.seq_b, x.author_a, x.title_b))
    assert found == {t: sorted(some)[:k] for t, some in every.items()} and len(found) == 3


def test_pairs_are_not_listed_to_find_the_first(frame):
    """3,000 papers of one topic conflict with one another; a hundred rows or so are made of them."""
    df = frame([(n, "t", "contradict no benefit", ["a"], ["A"]) for n in range(3000)], "seq long, title string, abstract string, topics array<string>, authors array<string>")
    found = controversy_pairs(df, 10, PATTERNS, DIRECTIONS)
    assert [(r.seq_a, r.seq_b) for r in found.orderBy("rank").collect()] == [(0, n) for n in range(1, 11)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def edges(lists):
    out = collections.Counter()
    for names in lists:
        named = [n for n in names or [] if n]
        out.update({(a, b) for (i, a), (j, b) in itertools.product(enumerate(named), repeat=2) if i < j})
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_coauthors_with_weights(frame, block):
    r = random.Random(block)
    lists = [[r.choice(["A", "B", "C", "D", "E", "F", "", None]) for _ in range(r.randrange(0, 9))] for _ in range(40)] + [None, ["A"], ["A", "A"]]
    df = frame([(k, x) for k, x in enumerate(lists)], "seq long, authors array<string>")
    assert {(x.src, x.dst): x.weight for x in coauthor_edges(df, block).collect()} == edges(lists)


def test_a_list_of_thousands_of_authors(spark):
    """Its pairs are made by many rows of bounded size, which Spark can deal to tasks."""
    n = 2500
    df = spark.range(1).select(F.col("id").alias("seq"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("A"), k)).alias("authors"))
    found = coauthor_edges(df)
    assert found.agg(F.count(F.lit(1)), F.max("weight")).first()[:] == (n * (n - 1) // 2, 1)


def test_papers_of_many_authors(frame):
    """More authors than may be broadcast are joined all the same."""
    df = frame([(1, "t", ["A", "B"]), (2, "u", ["B", "B"])], "seq long, title string, authors array<string>")
    found = author_papers(df, frame([("B",), ("B",), ("Z",)], "author string")).collect()
    assert sorted((r.author, r.seq) for r in found) == [("B", 1), ("B", 2), ("B", 2)]
