"""The driver's tables seen as documents, papers, citations and chunks; each view also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")


def first_line(text):
    return F.substring_index(text, "\n", 1)


def other_lines(text):
    cut = F.instr(text, "\n")
    return F.when(cut > 0, F.substring(text, cut + 1, F.length(text))).otherwise("")


# Documents as papers: first line = title, the rest = abstract, source = journal and topic.
PAPERS = r"""
papers AS (
  SELECT d.doc_id AS seq, split_part(d.text, chr(10), 1) AS title,
    CASE WHEN contains(d.text, chr(10)) THEN substr(d.text, length(split_part(d.text, chr(10), 1)) + 2)
      ELSE '' END AS abstract,
    d.source AS journal, d.lang, d.source, 2000 + (d.n_chars % 20)::INT AS year,
    CASE WHEN l.quality = 1 THEN 'A' WHEN l.quality = 0 THEN 'C' END AS evidence_level,
    (d.n_chars % 101) / 100::DOUBLE AS clinical_importance,
    CASE WHEN d.lang = 'en' THEN '10.5/' || md5(d.text) END AS doi,
    DATE '2024-01-31' - (d.n_chars % 40)::INT AS publication_date
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
texts AS (SELECT *, lower(title || ' ' || abstract) AS txt FROM papers)"""


def papers(spark: SparkSession, sf_dir: str, hashed: bool = False) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    text = F.col("text")
    return docs.select(
        F.col("doc_id").alias("seq"),
        first_line(text).alias("title"),
        other_lines(text).alias("abstract"),
        F.col("source").alias("journal"),
        "lang",
        "source",
        (2000 + F.col("n_chars") % 20).cast("int").alias("year"),
        F.when(F.col("quality") == 1, "A").when(F.col("quality") == 0, "C").alias("evidence_level"),
        ((F.col("n_chars") % 101) / F.lit(100.0)).alias("clinical_importance"),
        F.when(F.col("lang") == "en", F.concat(F.lit("10.5/"), F.md5("text"))).alias("doi"),
        F.date_sub(F.lit("2024-01-31").cast("date"), (F.col("n_chars") % 40).cast("int")).alias("publication_date"),
        F.array("source").alias("topics"),
        F.slice(F.split(text, r"\s+"), 1, 3).alias("authors"),
        *([F.md5("text").alias("hash")] if hashed else []),
    )


# Orders as articles: suppliers = authors, segment = journal, part types = topics.
LITERATURE = r"""
lines AS (
  SELECT l.l_orderkey AS k, l.l_linenumber AS ln, l.l_suppkey AS supp, l.l_partkey AS pk, p.p_name, p.p_type
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
author_lists AS (
  SELECT k, list('S' || supp ORDER BY m, supp) AS authors
  FROM (SELECT k, supp, min(ln) AS m FROM lines GROUP BY k, supp) GROUP BY k),
line_lists AS (
  SELECT k, string_agg(p_name, ' ' ORDER BY ln, supp, pk) AS title, list_sort(list(DISTINCT p_type)) AS topics
  FROM lines GROUP BY k),
literature AS (
  SELECT o.o_orderkey AS seq, t.title, lower(array_to_string(t.topics, ' ')) AS abstract, a.authors, t.topics,
    c.c_mktsegment AS journal, o.o_orderdate::DATE AS publication_date, year(o.o_orderdate)::INT AS year,
    '10.1/' || o.o_orderkey AS doi, n.n_name AS country, r.r_name AS institution,
    n.n_name AS affiliation, o.o_orderpriority AS source,
    CASE o.o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'C' END AS evidence_level
  FROM orders o JOIN author_lists a ON a.k = o.o_orderkey JOIN line_lists t ON t.k = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)"""


def literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    entry = F.struct("l_linenumber", "l_suppkey", "l_partkey", "p_name", "p_type")
    grouped = joined.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(entry)).alias("lines")
    )
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customer = (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    # the lines of an order move once: customers meet the narrow rows of orders first
    orders = table(spark, sf_dir, "orders").join(customer, "o_custkey").join(grouped, "o_orderkey")
    topics = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x.p_type)))
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").alias("work_id"),
        F.array_join(F.transform("lines", lambda x: x.p_name), " ").alias("title"),
        F.lower(F.array_join(topics, " ")).alias("abstract"),
        F.transform(
            F.array_distinct(F.transform("lines", lambda x: x.l_suppkey)), lambda s: F.concat(F.lit("S"), s)
        ).alias("authors"),
        topics.alias("topics"),
        F.col("c_mktsegment").alias("journal"),
        F.to_date("o_orderdate").alias("publication_date"),
        F.year("o_orderdate").alias("year"),
        F.concat(F.lit("10.1/"), F.col("o_orderkey")).alias("doi"),
        F.lit(None).cast("string").alias("pmid"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("institution"),
        F.col("n_name").alias("affiliation"),
        F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_orderstatus") == "F", "A")
        .when(F.col("o_orderstatus") == "O", "B")
        .otherwise("C")
        .alias("evidence_level"),
    )


# A line's part key names the order it cites.
CITATIONS = """
citations AS (
  SELECT l_orderkey AS citing_id, l_partkey AS cited_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS position
  FROM lineitem)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by line within the citing order; the position is only ever compared inside one order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("citing_id"),
        F.col("l_partkey").alias("cited_id"),
        F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("position"),
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: the label is the document."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").cast("long").alias("document_id"),
        F.col("vec_id").alias("chunk_index"),
        "embedding",
    )
