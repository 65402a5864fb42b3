"""Guideline, citation check and keyword answer workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.operators import guidelines as ops
from paperlake.operators.retrieval import enrich_hits
from paperlake.plans.guidelines import ingest_guidelines
from workloads.documents import TRIM
from workloads.registry import any_sql, workload
from workloads.vectors import CENTROIDS, RANKED, hits
from workloads.views import chunk_vectors, first_line, table

# Conversations as guidelines: every turn is a block, its first line the heading.
TEXTS = """
guideline_texts AS (SELECT conv_id AS guideline_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def guideline_texts(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return (
        table(spark, sf_dir, "conversations")
        .groupBy(F.col("conv_id").alias("guideline_id"))
        .agg(F.array_join(F.transform(turns, lambda t: t.text), "\n\n").alias("text"))
        .withColumn("title", first_line(F.col("text")))
        .withColumn("seq", F.col("guideline_id"))
    )


BLOCKS = rf"""{TEXTS},
b AS (SELECT guideline_id, generate_subscripts(p, 1) - 1 AS section_index, unnest(p) AS block FROM (
  SELECT guideline_id, string_split(trim(text, {TRIM}), chr(10) || chr(10)) AS p FROM guideline_texts)),
n AS (SELECT *, string_split(trim(block, {TRIM}), chr(10)) AS lines FROM b),
blocks AS (SELECT guideline_id, section_index::INT AS section_index, lines[1] AS heading,
  CASE WHEN len(lines) > 1 THEN array_to_string(list_slice(lines, 2, len(lines)), chr(10)) ELSE block END AS content FROM n)"""


@workload("guideline_sections", f"WITH {BLOCKS} SELECT * FROM blocks")
def guideline_sections(spark, sf_dir):
    return ops.split_guidelines(guideline_texts(spark, sf_dir))


# What follows the statements of an order, by its key modulo 4: each level and pregnancy class once.
ENDINGS = (
    "\nУровень доказательств A. Противопоказано при беременности.",
    "\nEvidence level b (case series). Не следует применять детям.",
    "\nУровень доказательств C. С осторожностью при беременности.",
    "\nEvidence level d. Может применяться при беременности.",
)


# How statements begin, in the order of their bytes.
BEGINNINGS = (
    "We do not recommend ", "We recommend ", "We strongly recommend ",
    "Настоятельно рекомендуется ", "Не рекомендуется ", "Рекомендуется ",
)


# Line items written as graded statements; lists hold numbers, of which the text is made when they are whole.
def statements(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus"
    )
    graded = (
        F.when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", 3).otherwise(2))
        .when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", 4).otherwise(0))
        .otherwise(F.when(F.col("l_linestatus") == "O", 5).otherwise(1))
    )
    entry = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", graded.alias("kind"))))
    begin = F.array(*[F.lit(b) for b in BEGINNINGS])
    sentence = lambda e: F.concat(F.get(begin, e.kind), F.lit("part "), e.l_partkey, F.lit(" of "), e.l_suppkey, F.lit("."))
    text = F.concat(
        F.array_join(F.transform(entry, sentence), "\n"),
        F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("l_orderkey") % 4 + 1).cast("int")),
    )
    return lines.groupBy("l_orderkey").agg(text.alias("content")).select(
        F.col("l_orderkey").alias("guideline_id"), F.lit(0).alias("section_index"),
        F.concat(F.lit("Order "), "l_orderkey").alias("heading"), "content",
    )


STATEMENTS = """
said AS (
  SELECT l_orderkey AS guideline_id, 'part ' || l_partkey || ' of ' || l_suppkey || '.' AS text,
    CASE WHEN l_linestatus = 'O' THEN 'ru' ELSE 'en' END AS lang,
    CASE l_returnflag WHEN 'A' THEN 'strong' WHEN 'R' THEN 'not_recommended' ELSE 'conditional' END AS strength,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 ELSE 2 END + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 3 END AS kind,
    l_linenumber AS ln, l_suppkey AS supp, l_partkey AS pk FROM lineitem),
once AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY guideline_id, text ORDER BY kind, ln, supp, pk) = 1),
recs AS (
  SELECT guideline_id, 0::INT AS section_index, text, lang, strength,
    (row_number() OVER (PARTITION BY guideline_id ORDER BY kind, ln, supp, pk) - 1)::INT AS position,
    ['A', 'B', 'C', 'D'][guideline_id % 4 + 1] AS evidence_level, 'Order ' || guideline_id AS population,
    ['при беременности', 'детям', '', ''][guideline_id % 4 + 1] AS contraindications,
    ['contraindicated', 'unknown', 'caution', 'safe'][guideline_id % 4 + 1] AS pregnancy, substr(sha256(text), 1, 16) AS text_hash
  FROM once)"""


@workload("recommendations", f"WITH {STATEMENTS} SELECT * FROM recs")
def recommendations(spark, sf_dir):
    found = ops.recommendations(statements(spark, sf_dir))
    return found.withColumn("contraindications", F.array_join("contraindications", "|"))


def statement_texts(spark, sf_dir):
    """The statements of an order as one guideline text."""
    text = F.concat("heading", F.lit("\n"), "content")
    return statements(spark, sf_dir).select(
        "guideline_id", F.col("heading").alias("title"), text.alias("text"), F.col("guideline_id").alias("seq")
    )


@workload("ingested_recommendations", f"WITH {STATEMENTS} SELECT * FROM recs")
def ingested_recommendations(spark, sf_dir):
    """The same recommendations by way of whole guideline texts."""
    found = ingest_guidelines(statement_texts(spark, sf_dir))["recommendations"]
    return found.withColumn("contraindications", F.array_join("contraindications", "|"))


@workload(
    "registered_recommendations",
    f"WITH {STATEMENTS} SELECT sha256(text) AS sha256, max(guideline_id) AS source_id FROM recs GROUP BY 1",
)
def registered_recommendations(spark, sf_dir):
    return ingest_guidelines(statement_texts(spark, sf_dir))["registered"]


@workload(
    "verified_citations",
    """WITH reg AS (SELECT sha256(text) AS h, max(item_id) AS source_id FROM benchmark GROUP BY 1),
cited AS (SELECT doc_id AS cited_id, text FROM documents UNION ALL SELECT 1000000000 + item_id, text FROM benchmark)
SELECT cited_id, sha256(text) AS sha256, source_id, source_id IS NOT NULL AS verified,
  CASE WHEN source_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence
FROM cited LEFT JOIN reg ON reg.h = sha256(cited.text)""",
)
def verified_citations(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    registered = ops.register_texts(bench.select(F.col("item_id").alias("source_id"), "text", F.col("item_id").alias("seq")))
    cited = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cited_id"), "text").unionByName(
        bench.select((F.lit(1000000000) + F.col("item_id")).alias("cited_id"), "text")
    )
    return ops.verify_citations(cited, registered).drop("text")


QUESTIONS = {"q1": "PART 17", "q2": "of 99."}


@workload(
    "keyword_recommendations",
    f"""WITH {STATEMENTS} SELECT 'q2' AS question_id, guideline_id, text, strength, 0.3::DOUBLE AS confidence FROM recs
WHERE {any_sql('lower(text)', 'of 99.'.split())} AND guideline_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'q1', guideline_id, text, strength, 0.3::DOUBLE FROM recs
WHERE {any_sql('lower(text)', 'part 17'.split())} AND guideline_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def keyword_recommendations(spark, sf_dir):
    allowed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("guideline_id"))
    recs = ops.recommendations(statements(spark, sf_dir), allowed)
    asked = spark.createDataFrame(list(QUESTIONS.items()), "question_id string, question string")
    found = ops.keyword_recommendations(asked, recs)
    return found.select("question_id", "guideline_id", "text", "strength", "confidence")


@workload(
    "guideline_keyword_search",
    f"""WITH {BLOCKS},
p AS (SELECT conv_id AS guideline_id, 10 AS pt FROM conversations WHERE turn = 0 AND contains(lower(split_part(text, chr(10), 1)), 'the')
  UNION ALL SELECT guideline_id, 5 FROM blocks WHERE contains(lower(content), 'the')
  UNION ALL SELECT conv_id, 3 FROM conversations WHERE role = 'assistant' AND contains(lower(text), 'the'))
SELECT guideline_id, sum(pt)::BIGINT AS score FROM p GROUP BY guideline_id ORDER BY score DESC, guideline_id LIMIT 10""",
)
def guideline_keyword_search(spark, sf_dir):
    """Assistant turns stand in for recommendations."""
    texts = guideline_texts(spark, sf_dir)
    recs = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        F.col("conv_id").alias("guideline_id"), "text"
    )
    sections = ops.split_guidelines(texts)
    found = ops.guideline_keyword_search("The", texts.drop("text"), sections, recs, 10)
    return found.select("guideline_id", "score")


@workload(
    "searched_guidelines",
    f"""WITH {CENTROIDS}, {RANKED.format('')}
SELECT DISTINCT r.query_id, d.label::BIGINT AS guideline_id, 'label ' || d.label AS title FROM ranked r
JOIN embeddings d ON d.vec_id = r.chunk_id WHERE rank <= 10""",
)
def searched_guidelines(spark, sf_dir):
    vectors = chunk_vectors(spark, sf_dir)
    owners = vectors.select(F.col("document_id").alias("guideline_id")).distinct()
    guidelines = owners.withColumn("title", F.concat(F.lit("label "), "guideline_id"))
    return ops.search_guidelines(guidelines, enrich_hits(hits(spark, sf_dir, 10), vectors))


@workload(
    "ingested_guidelines",
    f"""WITH {BLOCKS} SELECT count(DISTINCT guideline_id) AS guidelines, count(*) AS sections,
  sum(length(content))::BIGINT AS characters FROM blocks""",
)
def ingested_guidelines(spark, sf_dir):
    made = ingest_guidelines(guideline_texts(spark, sf_dir))
    return made["sections"].agg(
        F.countDistinct("guideline_id").alias("guidelines"),
        F.count(F.lit(1)).alias("sections"),
        F.sum(F.length("content")).alias("characters"),
    )
