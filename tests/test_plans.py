"""What the physical plans must and must not hold."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["first_seen", "term_search_first", "topic_groups", "themes", "vector_search", "citation_expansion"],
)
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize(
    "name",
    ["identity_edges", "controversial_papers", "citation_expansion", "verified_citations", "coauthor_edges", "run_report", "lookup"],
)
def test_joins_have_keys(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_years_are_filtered_in_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from paperlake.sources.search import year_range

    path = str(tmp_path / "articles")
    spark.range(100).select("id", (F.col("id") % 30 + 1990).cast("int").alias("year")).write.parquet(path)
    text = year_range(spark.read.parquet(path), 2000, 2005)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(year,2000)" in text and "LessThanOrEqual(year,2005)" in text


@pytest.mark.parametrize("name", ["editorial_digest", "merged_topics", "indexed_documents"])
def test_texts_are_scanned_once(spark, name):
    """What reads the rows again reads a checkpoint of few columns."""
    table = "lineitem" if name == "merged_topics" else "documents"
    assert plan(spark, name).count(f"{table}.parquet") <= 1
