"""Fields of reference strings, and the works they name."""

import pytest
from pyspark.sql import functions as F

from paperlake.operators.citing import citation_edges, fields_of, link_references, segmented

WORKS = "seq long, doi string, title string, year int"
REFERENCES = "document_id long, position int, raw_text string, doi string, title string, year int"


@pytest.mark.parametrize(
    "raw,quoted,wanted",
    [
        ("Doe J, Roe A. A title of words. J Parts. 2020;12(3):1-5. doi: 10.1234/x", "", ("Doe J, Roe A", "A title of words", "J Parts", "12", "3", "1", "5")),
        ("Doe J, Roe A. A title of words. J Parts. 2020;12(3):101-105.", "", ("Doe J, Roe A", "A title of words", "J Parts", "12", "3", "101", "105")),
        ("Doe, J. K., & Roe, A. (2020). A title. J Parts, 12(3), 7–9.", "", ("Doe, J. K., & Roe, A. (2020)", "A title", "J Parts", "12", "3", "7", "9")),
        ('Roe et al. "Is it so? It is". J Parts (2020).', "Is it so? It is", ("Roe et al", "Is it so? It is", "J Parts", None, None, None, None)),
        ("Only a title", "", (None, "Only a title", None, None, None, None, None)),
        ("", "", (None,) * 7),
    ],
)
def test_fields(frame, raw, quoted, wanted):
    found = frame([(raw, quoted)], "raw string, quoted string").select(fields_of(F.col("raw"), F.col("quoted")).alias("f")).first().f
    assert tuple(found) == wanted


def links(frame, references, works, **kw):
    df = frame([(1, k, "", *r) for k, r in enumerate(references)], REFERENCES)
    return {r.position: (r.cited_id, r.by, r.missing) for r in link_references(df, frame(works, WORKS), **kw).collect()}


def test_links(frame):
    works = [
        (7, "https://doi.org/10.1/A", "one two three four", 2000),
        (8, "10.1/a", "one two three four", 2003),
        (9, None, "one two three four five", 2000),
        (10, "", "six seven eight", None),
        (11, None, "six seven", 1999),
        (12, None, None, 1999),
    ]
    asked = [
        ("10.1/A", "something else", 1900),  # by DOI, the first record of it
        (None, "One two, three FOUR!", 2000),  # equal
        (None, "One two three four", 2003),  # equal, of that year
        (None, "one two three", 2001),  # a word missing here
        (None, "one two three four five six", 2000),  # a word missing there
        (None, "one two other four", 2002),  # another word in its place; 2003 is nearer than 2000
        ("10.9/unknown", "six seven eight", 1950),  # an unknown DOI; the year of the work is unknown
        (None, "six seven", 1999),  # too short
        (None, None, 1999),
        (None, "one two three four", 2010),  # too far
        (None, "four three two one", 2000),  # other order
    ]
    assert links(frame, asked, works) == {
        0: (7, "doi", 0), 1: (7, "title", 0), 2: (8, "title", 0), 3: (7, "title", 1), 4: (9, "title", 1), 5: (8, "title", 2), 6: (10, "title", 0),
    }
    assert links(frame, asked[9:10], works, years=10)[0] == (8, "title", 0)
    assert links(frame, [], works) == {} and links(frame, asked, []) == {}


def test_a_title_of_many_works_is_one_row_for_each_year(spark):
    works = spark.range(20_000).selectExpr("id seq", "cast(null as string) doi", "'the same old title' title", "cast(2000 + id % 3 as int) year")
    asked = spark.range(2_000).selectExpr(
        "id document_id", "0 position", "'' raw_text", "'' doi", "'The same old title' title", "2001 year"
    )
    found = link_references(asked, works)
    assert found.groupBy("cited_id", "missing").count().collect()[0][:] == (1, 0, 2000)


def test_edges_name_a_work_once(frame):
    df = frame([(1, 2, 5, "doi", 0), (1, 4, 5, "title", 1), (1, 3, 1, "doi", 0), (2, 0, 5, "doi", 0)], "document_id long, position int, cited_id long, by string, missing int")
    assert sorted(citation_edges(df).collect()) == [(1, 5, 2), (2, 5, 0)]


def test_titles_come_from_fields_where_none_is_quoted(frame):
    raw = 'Doe J, Roe A. A title of words. J Parts. 2020;12(3):1-5.'
    df = frame([(1, 0, raw, "", "", 2020), (1, 1, 'Roe. "Quoted".', "", "Quoted", None)], REFERENCES)
    assert [r.title for r in segmented(df).orderBy("position").collect()] == ["A title of words", "Quoted"]


def test_references_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(k):
        read.add(1)
        return "The same old title" if k % 2 else None

    works = spark.range(3).selectExpr("id seq", "cast(null as string) doi", "'the same old title' title", "cast(null as int) year")
    asked = spark.range(40).selectExpr("id document_id", "0 position", "'' raw_text", "'' doi", "cast(null as int) year").withColumn("title", title("document_id"))
    found = link_references(asked, works)
    assert found.groupBy("cited_id", "by", "missing").count().collect() == [(0, "title", 0, 20)]
    assert read.value == 40
