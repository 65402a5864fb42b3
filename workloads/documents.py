"""Chunking and parsing over the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlake.fixed_values import KNOWN_SECTIONS
from paperlake.operators import chunking, parsing
from workloads.registry import quoted, workload
from workloads.views import documents, first_line, other_lines, table

TRIM = r"chr(32) || chr(9) || chr(10) || chr(13)"
WORDS = rf"list_filter(string_split_regex(trim({{}}, {TRIM}), '\s+'), lambda x: x <> '')"


def n_words(text: str) -> str:
    return f"len({WORDS.format(text)})::INT"


FIXED = rf"""
w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 448)) AS start FROM w),
c AS (SELECT doc_id, start, len(w) AS n, len(list_slice(w, start + 1, start + 512)) AS word_count,
        array_to_string(list_slice(w, start + 1, start + 512), ' ') AS text FROM s),
chunks AS (
  SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_index,
    text, word_count::INT AS word_count, floor(word_count * 1.3::DOUBLE)::INT AS token_count, start + 512 < n AS more
  FROM c WHERE length(text) >= 20)"""


@workload(
    "chunk_fixed",
    f"""WITH {FIXED}
SELECT printf('%d_chunk_%04d', document_id, chunk_index) AS chunk_id, document_id, chunk_index, text, word_count,
  token_count,
  CASE WHEN chunk_index > 0 THEN printf('%d_chunk_%04d', document_id, chunk_index - 1) ELSE '' END AS previous_chunk,
  CASE WHEN more THEN printf('%d_chunk_%04d', document_id, chunk_index + 1) ELSE '' END AS next_chunk
FROM chunks""",
)
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_fixed(documents(spark, sf_dir)).drop("section", "heading")


@workload(
    "document_stats",
    f"""WITH {FIXED}
SELECT document_id, count(*) AS total_chunks, sum(token_count)::BIGINT AS total_tokens,
  sum(word_count)::BIGINT AS total_words, 0::BIGINT AS total_tables, 0::BIGINT AS total_figures,
  0::BIGINT AS total_citations
FROM chunks GROUP BY document_id""",
)
def document_stats(spark, sf_dir):
    return chunking.document_stats(chunking.chunk_fixed(documents(spark, sf_dir)))


@workload(
    "chunk_sentences",
    rf"""WITH s AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, trim(unnest(p), {TRIM}) AS text FROM (
    SELECT doc_id, string_split(regexp_replace(trim(text, {TRIM}), '([.!?])\s+([A-Z"''(])', '\1' || chr(1) || '\2', 'g'),
      chr(1)) AS p FROM documents)),
k AS (SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index
  FROM s WHERE length(text) >= 20)
SELECT printf('%d_chunk_%04d', doc_id, chunk_index) AS chunk_id, doc_id AS document_id, chunk_index, text,
  {n_words('text')} AS word_count, {n_words('text')} AS token_count
FROM k""",
)
def chunk_sentences(spark, sf_dir):
    return chunking.chunk_sentences(documents(spark, sf_dir)).drop("section", "heading", "previous_chunk", "next_chunk")


# A paper body made of each document: its title, a marked abstract and an introduction.
BODY = r"""
bodies AS (
  SELECT doc_id, split_part(text, chr(10), 1) || chr(10) || 'Abstract' || chr(10) ||
    CASE WHEN contains(text, chr(10)) THEN substr(text, length(split_part(text, chr(10), 1)) + 2) ELSE '' END ||
    chr(10) || '2.1 Study Design' || chr(10) || text || chr(10) || 'INTRODUCTION' || chr(10) ||
    split_part(text, chr(10), 1) AS text
  FROM documents)"""


def bodies(spark, sf_dir):
    text = F.col("text")
    body = F.concat_ws(
        "\n", first_line(text), F.lit("Abstract"), other_lines(text), F.lit("2.1 Study Design"), text,
        F.lit("INTRODUCTION"), first_line(text),
    )
    return documents(spark, sf_dir).select("document_id", body.alias("text"))


KNOWN = ", ".join(quoted(k) for k in KNOWN_SECTIONS)
SECTIONS = rf"""{BODY},
raw_lines AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM bodies)),
stripped AS (SELECT *, trim(line, {TRIM}) AS s FROM raw_lines),
levels AS (SELECT *, CASE
    WHEN s = '' THEN 0
    WHEN regexp_matches(s, '^\d+\.\d+(?:\.\d+)*\s+.+') THEN 2
    WHEN lower(s) IN ({KNOWN}) THEN 1
    WHEN len(string_split_regex(s, '\s+')) <= 8 AND NOT regexp_matches(s, '[.:;]$')
      AND ((s = upper(s) AND s <> lower(s))
        OR (s[1] = upper(s[1]) AND s[1] <> lower(s[1]) AND NOT regexp_matches(s, '[.?!]$'))) THEN 1
    ELSE 0 END AS level FROM stripped),
grouped AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM levels),
found AS (
  SELECT doc_id, g,
    coalesce(max(CASE WHEN level = 2 THEN trim(regexp_replace(s, '^\d+\.\d+(?:\.\d+)*\s+', ''), {TRIM})
      WHEN level = 1 THEN s END), 'Abstract') AS heading,
    trim(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), {TRIM}) AS content,
    greatest(max(level), 1)::INT AS level
  FROM grouped GROUP BY doc_id, g),
kept AS (SELECT * FROM found WHERE length(content) >= 20),
every AS (
  SELECT doc_id, g, heading, content, level FROM kept
  UNION ALL
  SELECT doc_id, 0, 'Body', trim(text, {TRIM}), 1 FROM bodies WHERE doc_id NOT IN (SELECT doc_id FROM kept)),
sections AS (
  SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS section_index,
    heading, content, level FROM every)"""


@workload("sections", f"WITH {SECTIONS} SELECT * FROM sections")
def sections(spark, sf_dir):
    return parsing.sections(bodies(spark, sf_dir))


@workload(
    "chunk_sections",
    f"""WITH {SECTIONS},
long AS (SELECT * FROM sections WHERE length(trim(content, {TRIM})) >= 20),
pieces AS (
  SELECT document_id, section_index, heading AS section, heading, content AS text FROM long
  UNION ALL
  SELECT doc_id, 0, 'Body', '', text FROM bodies WHERE doc_id NOT IN (SELECT document_id FROM long)),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY document_id ORDER BY section_index) - 1)::INT AS chunk_index FROM pieces)
SELECT printf('%d_chunk_%04d', document_id, chunk_index) AS chunk_id, document_id, chunk_index, section, heading,
  trim(text, {TRIM}) AS text, {n_words('text')} AS word_count, {n_words('text')} AS token_count
FROM numbered""",
)
def chunk_sections(spark, sf_dir):
    found = chunking.chunk_sections(parsing.with_sections(bodies(spark, sf_dir)))
    return found.drop("previous_chunk", "next_chunk")


@workload(
    "document_metadata",
    rf"""WITH {BODY},
filled AS (
  SELECT doc_id, list_filter(list_transform(string_split(trim(text, {TRIM}), chr(10)), lambda x: trim(x, {TRIM})),
    lambda x: x <> '') AS f FROM bodies),
opened AS (SELECT doc_id, f, list_position(list_transform(f, lambda x: starts_with(lower(x), 'abstract')), true) AS a FROM filled),
after AS (SELECT doc_id, f, list_filter(list_slice(f, a + 1, len(f)), lambda x: NOT starts_with(lower(x), 'abstract')) AS r FROM opened),
stopped AS (SELECT *, coalesce(list_position(list_transform(r, lambda x: starts_with(lower(x), 'introduction')
  OR starts_with(lower(x), 'background') OR starts_with(x, '1.')), true), 0) AS z FROM after)
SELECT doc_id AS document_id, f[1] AS title,
  trim(' ' || array_to_string(CASE WHEN z = 0 THEN r ELSE list_slice(r, 1, z - 1) END, ' '), {TRIM}) AS abstract
FROM stopped""",
)
def document_metadata(spark, sf_dir):
    return parsing.with_metadata(bodies(spark, sf_dir)).drop("text")


@workload(
    "captions",
    rf"""WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, trim(unnest(p), {TRIM}) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
o AS (SELECT *, starts_with(lower(line), 'th') AS opens FROM l),
n AS (SELECT *, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3, lead(line, 4) OVER w AS l4,
  lead(opens, 1) OVER w AS o1, lead(opens, 2) OVER w AS o2, lead(opens, 3) OVER w AS o3, lead(opens, 4) OVER w AS o4
  FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, l1 IS NOT NULL AND l1 <> '' AND NOT o1 AS g1, l2 IS NOT NULL AND l2 <> '' AND NOT o2 AS g2,
  l3 IS NOT NULL AND l3 <> '' AND NOT o3 AS g3, l4 IS NOT NULL AND l4 <> '' AND NOT o4 AS g4 FROM n)
SELECT doc_id AS document_id, 1::INT AS page_number,
  (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS caption_index,
  line || CASE WHEN g1 THEN ' ' || l1 ELSE '' END || CASE WHEN g1 AND g2 THEN ' ' || l2 ELSE '' END
   || CASE WHEN g1 AND g2 AND g3 THEN ' ' || l3 ELSE '' END
   || CASE WHEN g1 AND g2 AND g3 AND g4 THEN ' ' || l4 ELSE '' END AS caption
FROM g WHERE opens""",
)
def captions(spark, sf_dir):
    pages = documents(spark, sf_dir).withColumn("page_number", F.lit(1))
    return parsing.captions(pages, prefixes=("th",))


@workload(
    "figures",
    rf"""WITH l AS (
  SELECT page_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (
    SELECT page_id, string_split(replace(replace(html, chr(10), ' '), '<li>', chr(10) || 'Figure '), chr(10)) AS p FROM pages)),
c AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS k, trim(line, {TRIM}) AS caption
  FROM l WHERE starts_with(lower(trim(line, {TRIM})), 'fig')),
m AS (SELECT page_id, unnest(range(0, len(string_split(html, '</p>')) - 1)) AS k FROM pages)
SELECT m.page_id AS document_id, 1::INT AS page_number, m.k::INT AS image_index,
  md5(coalesce(c.caption, '')) AS caption_md5
FROM m LEFT JOIN c ON c.page_id = m.page_id AND c.k = m.k""",
)
def figures(spark, sf_dir):
    """List items of a page read as captions, paragraphs as images."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("document_id"),
        F.lit(1).alias("page_number"),
        F.replace(F.replace("html", F.lit("\n"), F.lit(" ")), F.lit("<li>"), F.lit("\nFigure ")).alias("text"),
        (F.size(F.split("html", "</p>")) - 1).alias("n_images"),
    )
    found = parsing.figures(pages).withColumn("caption_md5", F.md5("caption"))
    return found.drop("caption")


# Line items of an order as a pipe table inside a page.
@workload(
    "pipe_tables",
    """WITH rows AS (
  SELECT l_orderkey, count(*) AS n_rows, string_agg('| ' || l_partkey || ' | ' || l_suppkey || ' |', chr(10)
    ORDER BY l_linenumber, l_suppkey, l_partkey) AS body FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS document_id, 1::INT AS page_number, t.table_index::INT AS table_index, 'part|supplier' AS headers,
  n_rows::INT AS n_rows, '| part | supplier |' || chr(10) || '|---|---|' || chr(10) || body AS markdown
FROM rows, (SELECT unnest([0, 1]) AS table_index) t""",
)
def pipe_tables(spark, sf_dir):
    entry = F.struct("l_linenumber", "l_suppkey", "l_partkey")
    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("document_id"))
        .agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    )
    body = F.array_join(
        F.transform("rows", lambda r: F.concat(F.lit("| "), r.l_partkey, F.lit(" | "), r.l_suppkey, F.lit(" |"))), "\n"
    )
    block = F.concat(F.lit("| part | supplier |\nnot a row\n|-----|-------|\n"), body)
    pages = rows.select(
        "document_id",
        F.lit(1).alias("page_number"),
        F.concat(F.lit("Items\n"), block, F.lit("\n \nmore\n"), block).alias("text"),
    )
    found = parsing.pipe_tables(pages)
    return found.select(
        "document_id",
        "page_number",
        "table_index",
        F.array_join("headers", "|").alias("headers"),
        F.size("rows").alias("n_rows"),
        "markdown",
    )


@workload(
    "references",
    """WITH r AS (
  SELECT l.l_orderkey AS document_id, row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_suppkey, l.l_partkey) AS n,
    l.l_partkey, l.l_suppkey, p.p_name, year(l.l_shipdate) AS y FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
x AS (SELECT document_id, n::INT AS position, n::VARCHAR AS "index",
  'S' || l_suppkey || ' et al. "' || p_name || '". J Parts (' || y || '). doi: 10.1234/' || l_partkey || '.' AS raw_text,
  '10.1234/' || l_partkey AS doi, y::INT AS year, p_name AS title FROM r)
SELECT * FROM x UNION ALL
SELECT DISTINCT document_id, 0, '', 'References', '', NULL, '' FROM x""",
)
def references(spark, sf_dir):
    """Line items as numbered references that name part, supplier and ship year."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey"
    )
    entry = F.struct(
        "l_linenumber", "l_suppkey", "l_partkey", "p_name", F.year("l_shipdate").cast("string").alias("y")
    )
    cited = lines.groupBy(F.col("l_orderkey").alias("document_id")).agg(
        F.array_sort(F.collect_list(entry)).alias("rows")
    )
    item = F.transform(
        "rows",
        lambda r, i: F.concat(
            F.lit("["), i + 1, F.lit("] S"), r.l_suppkey, F.lit(' et al. "'), r.p_name, F.lit('". J Parts ('), r.y,
            F.lit("). doi: 10.1234/"), r.l_partkey, F.lit("."),
        ),
    )
    docs = cited.select(
        "document_id", F.concat(F.lit("References\n"), F.array_join(item, "\n")).alias("text")
    )
    return parsing.references(docs)


@workload(
    "markdown",
    f"""WITH {SECTIONS},
filled AS (
  SELECT doc_id, trim(split_part(trim(text, {TRIM}), chr(10), 1), {TRIM}) AS title FROM bodies),
parts AS (
  SELECT document_id, string_agg(repeat('#', least(level + 1, 6)::INT) || ' ' || heading || chr(10) || chr(10) || content || chr(10),
    chr(10) ORDER BY section_index) AS body FROM sections GROUP BY document_id)
SELECT p.document_id, length(body) AS section_length, md5(body) AS section_md5, f.title
FROM parts p JOIN filled f ON f.doc_id = p.document_id""",
)
def markdown(spark, sf_dir):
    """The section part of the Markdown, between the abstract and the references."""
    pages = bodies(spark, sf_dir).select(
        "document_id", F.lit(1).alias("page_number"), "text", F.lit(0).alias("n_images")
    )
    parsed = parsing.parse_documents(pages)
    shown = F.col("markdown")
    after_abstract = F.when(
        F.col("abstract") != "",
        F.substring(shown, F.instr(shown, "## Abstract\n") + F.length(F.concat(F.lit("## Abstract\n\n"), F.col("abstract"), F.lit("\n\n"))), F.length(shown)),
    ).otherwise(F.substring(shown, F.length(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"))) + 1, F.length(shown)))
    body = F.substring_index(after_abstract, "\n## References\n", 1)
    return parsed.select(
        "document_id", F.length(body).cast("long").alias("section_length"), F.md5(body).alias("section_md5"), "title"
    )


@workload(
    "extraction_stats",
    f"""WITH {SECTIONS}
SELECT b.doc_id AS document_id, 1::INT AS total_pages, length(b.text)::INT AS total_characters,
  count(*)::INT AS sections_found, 1::INT AS references_found, 0::INT AS tables_found, 0::INT AS figures_found,
  false AS ocr_required, 'completed' AS status
FROM bodies b JOIN sections s ON s.document_id = b.doc_id GROUP BY b.doc_id, b.text""",
)
def extraction_stats(spark, sf_dir):
    pages = bodies(spark, sf_dir).select(
        "document_id", F.lit(1).alias("page_number"), "text", F.lit(0).alias("n_images")
    )
    return parsing.extraction_stats(parsing.parse_documents(pages))


OCR = rf"""turns AS (
  SELECT conv_id AS document_id, turn AS page_number, split_part(text, ' ', 1) || CASE WHEN role = 'user' THEN text ELSE '' END AS text,
    (length(text) % 3)::INT AS n_images FROM conversations)"""


def turn_pages(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"),
        F.col("turn").alias("page_number"),
        F.concat(F.substring_index(text, " ", 1), F.when(F.col("role") == "user", text).otherwise("")).alias("text"),
        (F.length(text) % 3).alias("n_images"),
    )


@workload(
    "ocr_candidates",
    f"WITH {OCR} SELECT * FROM turns WHERE length(trim(text, {TRIM})) < 50 AND n_images > 0",
)
def ocr_candidates(spark, sf_dir):
    return parsing.ocr_candidates(turn_pages(spark, sf_dir))


@workload(
    "ocr_flags",
    f"""WITH {OCR} SELECT document_id, bool_or(length(trim(text, {TRIM})) < 50 AND n_images > 0) AS ocr_required,
  count(*) AS total_pages FROM turns GROUP BY document_id""",
)
def ocr_flags(spark, sf_dir):
    return parsing.ocr_flags(turn_pages(spark, sf_dir))


@workload(
    "assembled_pages",
    """SELECT conv_id AS document_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, count(*)::INT AS n_pages
FROM conversations GROUP BY conv_id""",
)
def assembled_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text", F.lit(0).alias("n_images")
    )
    found = parsing.assemble_pages(pages)
    return found.select("document_id", F.md5("text").alias("text_md5"), F.size("pages").alias("n_pages"))
