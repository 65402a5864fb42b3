"""Full-text candidates of articles, and checks over fetched files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.fixed_values import ARCHIVE_URL, DOI_URL, FETCH_URL
from paperlake.functions.rows import explode_once
from paperlake.functions.text import blank_to_null
from paperlake.session import cut_lineage

# Accepted MIME types per kind of download.
MIME_TYPES = {
    "pdf": ("application/pdf",),
    "xml": ("application/xml", "text/xml", "application/xhtml+xml"),
    "html": ("text/html",),
}
PDF_MAGIC = "%PDF-"


def _candidate(priority: int, url: Column, mime: str, source: str, exists: Column) -> Column:
    return F.when(
        exists,
        F.struct(
            F.lit(priority).alias("priority"),
            url.alias("url"),
            F.lit(mime).alias("mime_type"),
            F.lit(source).alias("resolver"),
        ),
    )


def fulltext_candidates(articles: DataFrame) -> DataFrame:
    """Distinct full-text urls per article, archive first, then DOI, then publisher; no url is requested."""
    pmcid, doi = blank_to_null(F.col("pmcid")), blank_to_null(F.col("doi"))
    pdf_url, url = blank_to_null(F.col("pdf_url")), blank_to_null(F.col("url"))
    archive = F.concat(F.lit(ARCHIVE_URL), pmcid)
    bare_doi = F.ltrim(F.ltrim(doi, F.lit("doi:")), F.lit("/"))
    found = F.array_compact(
        F.array(
            _candidate(0, F.concat(archive, F.lit("/pdf/")), "application/pdf", "pmc", pmcid.isNotNull()),
            _candidate(1, F.concat(archive, F.lit("/pdf/main.pdf")), "application/pdf", "pmc", pmcid.isNotNull()),
            _candidate(
                2,
                F.concat(
                    F.lit(FETCH_URL),
                    pmcid,
                    F.lit("&rettype=xml&retmode=xml"),
                ),
                "application/xml",
                "pmc",
                pmcid.isNotNull(),
            ),
            _candidate(3, F.concat(F.lit(DOI_URL), bare_doi), "text/html", "doi", doi.isNotNull()),
            _candidate(4, pdf_url, "application/pdf", "publisher", pdf_url.isNotNull()),
            _candidate(
                5, url, "text/html", "publisher", url.isNotNull() & (pdf_url.isNull() | (url != pdf_url))
            ),
        )
    )
    # at most six per article, so duplicates are dropped inside the row
    urls = F.transform("_found", lambda c: c.url)
    distinct = F.filter("_found", lambda c, i: F.array_position(urls, c.url) == i + 1)
    listed = articles.select("article_id", found.alias("_found"))
    return (
        explode_once(listed, distinct, "c", "rank")
        .select("article_id", (F.col("rank") + 1).alias("rank"), "c.url", "c.mime_type", "c.resolver")
    )


def audit_contents(files: DataFrame, kind: str = "pdf", expected: DataFrame | None = None) -> DataFrame:
    """Check rows of (path, content, optional mime_type): checksum, size, type, magic bytes, copies.

    ``expected`` (path, sha256) adds ``checksum_ok``. Copies are counted by
    checksum, so no content is shuffled.
    """
    head = F.decode(F.substring("content", 1, 9), "ISO-8859-1")
    is_html = head.startswith("<!DOCTYPE") | head.startswith("<html") | head.startswith("<HTML")
    mime = (
        F.col("mime_type")
        if "mime_type" in files.columns
        else F.when(head.startswith(PDF_MAGIC), "application/pdf")
        .when(is_html, "text/html")
        .when(head.startswith("<?xml"), "application/xml")
        .otherwise("application/octet-stream")
    )
    measured = files.select(
        "path",
        F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").cast("long").alias("size"),
        mime.alias("mime_type"),
        is_html.alias("is_html"),
        head.startswith(PDF_MAGIC).alias("has_magic"),
    )
    problem = F.when(~F.col("mime_type").isin(*MIME_TYPES[kind]), F.lit("mime_type"))
    if kind == "pdf":
        problem = F.when(F.col("is_html"), F.lit("html_page")).otherwise(
            F.coalesce(problem, F.when(~F.col("has_magic"), F.lit("magic_bytes")))
        )
    # contents are read and hashed once; only these narrow rows are kept for the count of copies
    checked = cut_lineage(measured.withColumn("problem", problem))
    copies = checked.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))
    out = checked.join(copies, "sha256").select(
        "path",
        "sha256",
        "size",
        "mime_type",
        "problem",
        "copies",
        (F.col("path") != F.col("first_path")).alias("is_copy"),
        F.substring("sha256", 1, 2).alias("prefix1"),
        F.substring("sha256", 3, 2).alias("prefix2"),
    )
    if expected is not None:
        want = expected.select("path", F.col("sha256").alias("_want"))
        out = out.join(want, "path", "left").withColumn("checksum_ok", F.col("sha256") == F.col("_want")).drop("_want")
    return out


def audit_files(spark: SparkSession, path: str, kind: str = "pdf", expected: DataFrame | None = None) -> DataFrame:
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    )
    return audit_contents(files, kind, expected)
