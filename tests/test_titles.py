"""Titles are normalised once for each row, with one pattern."""

import pytest
from pyspark.sql import functions as F

from paperlake.functions.text import normalize_title
from paperlake.operators import identity


@pytest.mark.parametrize(
    "title, expected",
    [(None, ""), ("", ""), (" -- ", ""), ("A  b", "a b"), ("Über-\tuns! ", "ber uns"), ("a - b", "a b"), ("é9\n\nX", "9 x"), ("İ", "i")],
)
def test_normalized(frame, title, expected):
    assert frame([(title,)], "title string").select(normalize_title(F.col("title"))).first()[0] == expected


def test_one_pattern_runs_once(frame, monkeypatch):
    monkeypatch.setattr(identity, "cut_lineage", lambda df: df)
    titles = identity.distinct_titles(frame([(1, "A b"), (2, "a  B"), (3, "-"), (4, None)], "seq long, title string"))
    assert [tuple(r) for r in titles.collect()] == [("a b", 1, ["a", "b"])]
    assert titles._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
