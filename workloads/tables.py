"""Knowledge base tables, run reports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperlake.operators.reports import run_errors, run_report
from paperlake.plans.ingest import index_documents, ingest_pages
from paperlake.session import cut_lineage, remove_folder, scratch_dir
from paperlake.sources import knowledge_base as kb
from paperlake.streaming import jobs
from workloads.discovery import FIRST_SEEN
from workloads.documents import FIXED, SECTIONS, bodies
from workloads.registry import workload
from workloads.views import PAPERS, papers, table


def run_folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df, folder: str):
    """``df``, computed now, so that the folder it was read from can go; Spark removes the copy when nobody needs it."""
    found = cut_lineage(df)
    remove_folder(df.sparkSession, folder)
    return found


@workload(
    "upserted_documents",
    """WITH old AS (SELECT doc_id AS document_id, text, 1 AS version FROM documents WHERE lang <> 'fr'),
new AS (SELECT doc_id AS document_id, lower(text) AS text, 2 AS version FROM documents WHERE lang <> 'en')
SELECT document_id, md5(text) AS text_md5, version FROM (
  SELECT * FROM new UNION ALL SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new))""",
)
def upserted_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    old = docs.where("lang <> 'fr'").select("document_id", "text", F.lit(1).alias("version"))
    new = docs.where("lang <> 'en'").select("document_id", F.lower("text").alias("text"), F.lit(2).alias("version"))
    first = new.withColumns({"text": F.lit("overwritten"), "order": F.lit(0)})
    updates = first.unionByName(new.withColumn("order", F.lit(1)))
    return kb.upsert(old, updates, ["document_id"], "order").select("document_id", F.md5("text").alias("text_md5"), "version")


@workload(
    "deleted_documents",
    "SELECT doc_id AS document_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def deleted_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return kb.delete_rows(docs, toxic, "document_id")


@workload(
    "existed_documents",
    """SELECT item_id AS document_id, item_id IN (SELECT doc_id FROM labels) AS existed FROM benchmark""",
)
def existed_documents(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document_id"))
    held = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return kb.existed(held, ids, "document_id")


@workload("found_documents", f"WITH {PAPERS} SELECT seq, title FROM papers WHERE contains(lower(title), 'thatin')")
def found_documents(spark, sf_dir):
    return kb.search_documents(papers(spark, sf_dir), "THATIN").select("seq", "title")


@workload(
    "indexed_documents",
    f"""WITH {FIXED}, sums AS (SELECT document_id, count(*) AS c, sum(token_count) AS t, sum(word_count) AS w FROM chunks GROUP BY document_id)
SELECT doc_id AS document_id, CASE WHEN d.n_chars % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN d.n_chars % 7 = 0 THEN 'document has no text' END AS error,
  CASE WHEN d.n_chars % 7 = 0 THEN 0 ELSE coalesce(c, 0) END::BIGINT AS total_chunks,
  CASE WHEN d.n_chars % 7 = 0 THEN 0 ELSE coalesce(t, 0) END::BIGINT AS total_tokens,
  CASE WHEN d.n_chars % 7 = 0 THEN 0 ELSE coalesce(w, 0) END::BIGINT AS total_words
FROM documents d LEFT JOIN sums ON sums.document_id = d.doc_id""",
)
def indexed_documents(spark, sf_dir):
    """Documents whose length is a multiple of 7 lose their text, to show failed rows."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("n_chars") % 7 != 0, F.col("text")).alias("text")
    )
    return index_documents(docs)["documents"].select(
        "document_id", "status", "error", "total_chunks", "total_tokens", "total_words"
    )


@workload(
    "knowledge_base",
    f"""WITH {FIXED}, kept AS (SELECT * FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'chunks', count(*) FROM kept UNION ALL SELECT 'embeddings', count(*) FROM kept""",
)
def knowledge_base(spark, sf_dir):
    """Two overlapping sets of documents put into tables, toxic documents deleted, the rest counted."""
    folder = run_folder(spark, "kb")
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    kb.write_tables(index_documents(docs.where("lang <> 'fr'").select("document_id", "text")), folder, 8)
    kb.put_documents(spark, folder, index_documents(docs.where("lang <> 'en'").select("document_id", "text")), 8)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    kb.remove_documents(spark, folder, toxic, 8)
    out = None
    for name, frame in kb.read_tables(spark, folder).items():
        count = frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = count if out is None else out.unionByName(count)
    return kept(out, folder)


@workload(
    "ingested_pages",
    f"""WITH {SECTIONS}, long AS (SELECT * FROM sections WHERE length(content) >= 20)
SELECT document_id, count(*) AS total_chunks FROM (
  SELECT document_id FROM long UNION ALL SELECT doc_id FROM bodies WHERE doc_id NOT IN (SELECT document_id FROM long)) GROUP BY document_id""",
)
def ingested_pages(spark, sf_dir):
    pages = bodies(spark, sf_dir).select("document_id", F.lit(1).alias("page_number"), "text", F.lit(0).alias("n_images"))
    return ingest_pages(pages)["documents"].select("document_id", "total_chunks")


# --- reports -----------------------------------------------------------------


def stage_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"),
        (F.get_json_object("props", "$.k").cast("int") >= 10).alias("ok"),
        F.col("value").alias("ms"),
        (F.col("user_id") % 5).alias("chunk_count"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.col("event_id").alias("paper"),
    )


@workload(
    "run_report",
    """WITH e AS (SELECT event_type AS stage, (props->>'$.k')::INT >= 10 AS ok, value AS ms, user_id % 5 AS chunk_count FROM events),
r AS (SELECT stage, ms, row_number() OVER (PARTITION BY stage ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM e),
p AS (SELECT stage, max(ms) FILTER (WHERE i = floor(n * 0.5::DOUBLE)) AS p50, max(ms) FILTER (WHERE i = floor(n * 0.9::DOUBLE)) AS p90,
  max(ms) FILTER (WHERE i = floor(n * 0.95::DOUBLE)) AS p95 FROM r GROUP BY stage)
SELECT stage, count(*) AS events, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failure,
  round(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*), 6) AS success_rate_pct, round(avg(ms), 4) AS avg_ms,
  round(avg(chunk_count), 6) AS avg_chunks, round(count(*) * 1000.0::DOUBLE / sum(ms), 4) AS throughput_per_s,
  CASE WHEN bool_and(ok) THEN 'completed' WHEN NOT bool_or(ok) THEN 'failed' ELSE 'partial' END AS status,
  any_value(p50) AS p50, any_value(p90) AS p90, any_value(p95) AS p95
FROM e JOIN p USING (stage) GROUP BY stage""",
)
def report(spark, sf_dir):
    found = run_report(stage_events(spark, sf_dir))
    return found.withColumns(
        {c: F.round(c, d) for c, d in (("success_rate_pct", 6), ("avg_ms", 4), ("avg_chunks", 6), ("throughput_per_s", 4))}
    )


@workload("run_errors", "SELECT event_type AS stage, event_id AS paper, props AS error FROM events WHERE event_type = 'error'")
def errors(spark, sf_dir):
    return run_errors(stage_events(spark, sf_dir))


# --- streams -----------------------------------------------------------------


def stream(spark, sf_dir, name: str):
    """The table as a stream, be it one file or a folder of files: a pattern of one name takes either."""
    return jobs.read_files(spark, f"{sf_dir}/[{name[0]}]{name[1:]}.parquet", table(spark, sf_dir, name).schema)


def event_stream(spark, sf_dir):
    return stream(spark, sf_dir, "events")


CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@workload(
    "period_counts",
    f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS s FROM events)
SELECT s::VARCHAR AS period_start, event_type, count(*) AS n FROM w WHERE s + INTERVAL 7 DAY {CLOSED} GROUP BY s, event_type""",
)
def period_counts(spark, sf_dir):
    """Weekly counts of a stream; the last, still open week is not emitted."""
    counted = jobs.period_counts(event_stream(spark, sf_dir), "event_type", "7 days")
    folder = run_folder(spark, "periods")
    done = kept(jobs.run_available(counted, f"{folder}/out", f"{folder}/checkpoint"), folder)
    return done.select(F.col("period_start").cast("string").alias("period_start"), "event_type", "n")


@workload(
    "sliding_counts",
    f"""WITH w AS (SELECT event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') - to_days(7 * k.k) AS s, ts
  FROM events, (SELECT unnest([0, 1]) AS k) k)
SELECT s::VARCHAR AS period_start, event_type, count(*) AS n FROM w
WHERE s + INTERVAL 14 DAY {CLOSED} AND ts < s + INTERVAL 14 DAY GROUP BY s, event_type""",
)
def sliding_counts(spark, sf_dir):
    counted = jobs.period_counts(event_stream(spark, sf_dir), "event_type", "14 days", "7 days")
    folder = run_folder(spark, "sliding")
    done = kept(jobs.run_available(counted, f"{folder}/out", f"{folder}/checkpoint"), folder)
    return done.select(F.col("period_start").cast("string").alias("period_start"), "event_type", "n")


@workload(
    "first_seen_stream",
    "SELECT DISTINCT user_id FROM events",
)
def first_seen_stream(spark, sf_dir):
    """The first event per user within the watermark delay, which covers the month."""
    once = jobs.first_seen_stream(event_stream(spark, sf_dir), "user_id", "ts", "60 days").select("user_id")
    folder = run_folder(spark, "first-seen")
    return kept(jobs.run_available(once, f"{folder}/out", f"{folder}/checkpoint"), folder)


@workload("first_seen_runs", f"WITH {PAPERS}, {FIRST_SEEN.format('papers')} SELECT seq, title FROM seen")
def first_seen_runs(spark, sf_dir):
    """Papers that arrive in two runs of one stream are let through as from one table."""
    jobs.keep_state_in_rocksdb(spark)
    folder = run_folder(spark, "first-seen-runs")
    items = papers(spark, sf_dir).select("seq", "doi", "title")
    half = (items.agg(F.max("seq")).first()[0] or 0) // 2
    for part in (items.where(F.col("seq") <= half), items.where(F.col("seq") > half)):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = jobs.first_seen_forever(jobs.read_files(spark, f"{folder}/in", items.schema))
        found = jobs.run_available(stream, f"{folder}/out", f"{folder}/checkpoint")
    return kept(found.select("seq", "title"), folder)


@workload("ingest_stream", f"WITH {FIXED} SELECT document_id, count(*) AS n_chunks FROM chunks GROUP BY document_id")
def ingest_stream(spark, sf_dir):
    """Documents arriving as a stream end up in the tables like a batch."""
    folder = run_folder(spark, "ingest")
    docs = stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    jobs.ingest_stream(docs, f"{folder}/kb", f"{folder}/checkpoint", buckets=8).awaitTermination()
    chunks = kb.read_tables(spark, f"{folder}/kb")["chunks"]
    return kept(chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks")), folder)
