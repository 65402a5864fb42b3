"""Parse document texts into sections, references, tables, captions and metadata.

Every parser is an array expression inside the document's row: a corpus is
parsed in one pass over its files, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.fixed_values import (
    ABSTRACT_STOPS, CAPTION_PREFIXES, DOI_IN_TEXT, KNOWN_SECTIONS, QUOTED, REFERENCE_BREAK, REFERENCE_NUMBER, SUB_HEADING,
)
from paperlake.functions.text import let, strip

BLANK_LINES = r"\n(?:[^\S\n]*\n)+"


def lines_of(col: Column) -> Column:
    return F.split(col, "\n")


def _starts_with(line: Column, prefixes: Iterable[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | line.startswith(prefix)
    return hit


def _cased_upper(col: Column) -> Column:
    return (col == F.upper(col)) & (col != F.lower(col))


# --- sections ----------------------------------------------------------------


def heading_level(line: Column, known: Iterable[str] = KNOWN_SECTIONS) -> Column:
    """0 for body text, 1 for a heading, 2 for a numbered sub-heading. ``line`` is stripped."""
    short = F.size(F.split(line, r"\s+")).between(1, 8)
    ends_softly = line.rlike(r"[.:;]\z")
    ends_sentence = line.rlike(r"[.?!]\z")
    looks_like_title = _cased_upper(line) | (_cased_upper(F.substring(line, 1, 1)) & ~ends_sentence)
    return (
        F.when(line == "", 0)
        .when(line.rlike(SUB_HEADING), 2)
        .when(F.lower(line).isin(*known), 1)
        .when(short & ~ends_softly & looks_like_title, 1)
        .otherwise(0)
    )


def is_heading(line: Column) -> Column:
    return heading_level(strip(line)) > 0


def sections_of(text: Column, min_len: int = 20) -> Column:
    """Array of sections: a heading line opens one, other lines join the open one, "Abstract" is open at the start."""

    def cut(lines: Column, stripped: Column, levels: Column, heads: Column) -> Column:
        starts = F.concat(F.array(F.lit(-1)), heads)

        def section(start: Column, k: Column) -> Column:
            length = F.coalesce(F.get(heads, k), F.size(lines)) - start - 1
            line = F.get(stripped, start)
            level = F.get(levels, start)
            return F.struct(
                F.when(start < 0, F.lit("Abstract"))
                .when(level == 2, strip(F.regexp_extract(line, SUB_HEADING, 2)))
                .otherwise(line)
                .alias("heading"),
                strip(F.array_join(F.slice(lines, start + 2, length), "\n")).alias("content"),
                F.when(start < 0, F.lit(1)).otherwise(level).alias("level"),
                length.alias("n_lines"),
            )

        kept = F.filter(
            F.transform(starts, section), lambda s: (s.n_lines > 0) & (F.length(s.content) >= min_len)
        )
        return F.transform(
            kept, lambda s: F.struct(s.heading.alias("heading"), s.content.alias("content"), s.level.alias("level"))
        )

    def with_levels(lines: Column, stripped: Column, levels: Column) -> Column:
        marked = F.transform(levels, lambda level, i: F.when(level > 0, i))
        return let(F.array_compact(marked), lambda heads: cut(lines, stripped, levels, heads))

    def with_stripped(lines: Column, stripped: Column) -> Column:
        levels = F.transform(stripped, lambda line: heading_level(line))
        return let(levels, lambda known: with_levels(lines, stripped, known))

    found = let(
        lines_of(text),
        lambda lines: let(
            F.transform(lines, lambda line: strip(line)), lambda stripped: with_stripped(lines, stripped)
        ),
    )
    whole = F.struct(F.lit("Body").alias("heading"), strip(text).alias("content"), F.lit(1).alias("level"))
    return let(found, lambda some: F.when(F.size(some) > 0, some).otherwise(F.array(whole)))


def with_sections(docs: DataFrame, min_len: int = 20) -> DataFrame:
    """Add ``sections``: array<struct<heading, content, level>> of each document's ``text``."""
    return docs.withColumn("sections", sections_of(F.col("text"), min_len))


def sections(docs: DataFrame, min_len: int = 20) -> DataFrame:
    """One row per section, in document order."""
    found = sections_of(F.col("text"), min_len)
    return explode_once(docs.select("document_id", "text"), found, "s", "section_index").select(
        "document_id", "section_index", "s.heading", "s.content", "s.level"
    )


# --- references --------------------------------------------------------------


def references_of(text: Column, limit: int | None = None) -> Column:
    """Array of references: the text cut before each numbered item; the first ``limit`` of them if given."""
    items = F.filter(F.split(text, REFERENCE_BREAK), lambda item: strip(item) != "")

    def reference(item: Column) -> Column:
        head = F.regexp_extract(item, REFERENCE_NUMBER, 0)
        number = F.regexp_extract(head, r"\d+", 0)
        return let(strip(F.substring(item, F.length(head) + 1, F.length(item))), lambda body: described(number, body))

    def described(number: Column, body: Column) -> Column:
        return F.struct(
            number.alias("index"),
            body.alias("raw_text"),
            F.rtrim(F.regexp_extract(body, DOI_IN_TEXT, 1), F.lit(".")).alias("doi"),
            F.nullif(F.regexp_extract(body, r"(\d{4})", 1), F.lit("")).cast("int").alias("year"),
            F.trim(F.regexp_extract(body, QUOTED, 0), F.lit("“”\"")).alias("title"),
        )

    found = F.filter(F.transform(items, reference), lambda r: r.raw_text != "")
    return found if limit is None else F.slice(found, 1, limit)


def references(docs: DataFrame, limit: int | None = None) -> DataFrame:
    found = references_of(F.col("text"), limit)
    return explode_once(docs.select("document_id", "text"), found, "r", "position").select(
        "document_id", "position", "r.*"
    )


# --- tables ------------------------------------------------------------------


def table_markdown(headers: Column, rows: Column) -> Column:
    head = F.array(
        F.concat(F.lit("| "), F.array_join(headers, " | "), F.lit(" |")),
        F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit("---")), "|"), F.lit("|")),
    )
    body = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return F.array_join(F.concat(head, body), "\n")


def pipe_tables_of(text: Column, strict: bool = False) -> Column:
    """Array of tables: lines ``|...|`` up to the next blank line; other lines between them are skipped.

    A separator row has dashes in every cell; ``strict=True`` wants exactly three.
    """
    separator = r"^---\z" if strict else r"^-+\z"
    row_lines = F.transform(
        F.split(text, BLANK_LINES),
        lambda block: F.filter(lines_of(block), lambda line: strip(line).rlike(r"(?s)^\|.+\|\z")),
    )

    def cells(line: Column) -> Column:
        return F.transform(F.split(F.trim(line, F.lit("|")), r"\|"), lambda c: strip(c))

    def table(lines: Column) -> Column:
        body = F.filter(
            F.transform(F.slice(lines, 2, F.size(lines)), cells),
            lambda row: ~F.forall(row, lambda c: c.rlike(separator)),
        )
        return F.struct(cells(F.element_at(lines, 1)).alias("headers"), body.alias("rows"))

    return F.transform(F.filter(row_lines, lambda b: F.size(b) > 0), table)


def pipe_tables(pages: DataFrame, strict: bool = False) -> DataFrame:
    page = pages.select("document_id", "page_number", "text")
    return (
        explode_once(page, pipe_tables_of(F.col("text"), strict), "t", "table_index")
        .select("document_id", "page_number", "table_index", "t.headers", "t.rows")
        .withColumn("markdown", table_markdown(F.col("headers"), F.col("rows")))
    )


# --- figures -----------------------------------------------------------------


def captions_of(text: Column, prefixes: Iterable[str] = CAPTION_PREFIXES, follow: int = 4) -> Column:
    """Array of captions: a caption line and up to ``follow`` lines after it, to a blank line or the next caption."""

    def caption(lines: Column, opens: Column, i: Column) -> Column:
        stops = F.zip_with(
            F.slice(lines, i + 2, follow), F.slice(opens, i + 2, follow), lambda line, o: (line == "") | o
        )
        return let(
            F.array_position(stops, F.lit(True)).cast("int"),
            lambda stop: F.array_join(
                F.slice(lines, i + 1, F.when(stop == 0, F.lit(follow + 1)).otherwise(stop)), " "
            ),
        )

    def all_captions(lines: Column, opens: Column) -> Column:
        marked = F.array_compact(F.transform(opens, lambda o, i: F.when(o, i)))
        return F.transform(marked, lambda i: caption(lines, opens, i))

    return let(
        F.transform(lines_of(text), lambda line: strip(line)),
        lambda lines: let(
            F.transform(lines, lambda line: _starts_with(F.lower(line), prefixes)),
            lambda opens: all_captions(lines, opens),
        ),
    )


def captions(pages: DataFrame, prefixes: Iterable[str] = CAPTION_PREFIXES) -> DataFrame:
    page = pages.select("document_id", "page_number", "text")
    return explode_once(page, captions_of(F.col("text"), prefixes), "caption", "caption_index").drop("text")


def figures(pages: DataFrame, prefixes: Iterable[str] = CAPTION_PREFIXES) -> DataFrame:
    """One row per image of a page (``n_images``), with the caption of the same ordinal or none."""
    return (
        pages.where(F.col("n_images") > 0)
        .select(
            "document_id",
            "page_number",
            captions_of(F.col("text"), prefixes).alias("_captions"),
            F.explode(F.sequence(F.lit(0), F.col("n_images").cast("int") - 1)).alias("image_index"),
        )
        .select(
            "document_id",
            "page_number",
            "image_index",
            F.coalesce(F.get("_captions", F.col("image_index")), F.lit("")).alias("caption"),
        )
    )


def ocr_candidates(pages: DataFrame, threshold: int = 50) -> DataFrame:
    """Pages with an image and almost no text."""
    return pages.where((F.length(strip(F.col("text"))) < threshold) & (F.col("n_images") > 0))


def ocr_flags(pages: DataFrame, threshold: int = 50) -> DataFrame:
    needs = (F.length(strip(F.col("text"))) < threshold) & (F.col("n_images") > 0)
    return pages.groupBy("document_id").agg(
        F.bool_or(F.coalesce(needs, F.lit(False))).alias("ocr_required"), F.count(F.lit(1)).alias("total_pages")
    )


# --- metadata, Markdown ------------------------------------------------------


def _first_chars(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def _abstract(filled: Column, limit: int | None) -> Column:
    """Of non-blank stripped lines: those after "abstract..." up to the introduction."""
    opens = F.transform(filled, lambda line: F.lower(line).startswith("abstract"))

    def body(first: Column) -> Column:
        after = F.filter(
            F.slice(filled, first + 1, F.size(filled)), lambda line: ~F.lower(line).startswith("abstract")
        )
        return F.when(first > 0, let(after, until_stop)).otherwise("")

    def until_stop(after: Column) -> Column:
        stops = F.transform(after, lambda line: _starts_with(F.lower(line), ABSTRACT_STOPS))
        return let(
            F.array_position(stops, F.lit(True)).cast("int"),
            lambda stop: F.array_join(
                F.slice(after, 1, F.when(stop == 0, F.size(after)).otherwise(stop - 1)), " "
            ),
        )

    joined = let(F.array_position(opens, F.lit(True)).cast("int"), body)
    return strip(_first_chars(F.concat(F.lit(" "), joined), limit))


def with_metadata(docs: DataFrame, title_chars: int | None = None, abstract_chars: int | None = None) -> DataFrame:
    """Add ``title`` (first line) and ``abstract`` (lines after one that starts with "abstract"), whole unless cut."""
    filled = F.filter(
        F.transform(lines_of(strip(F.col("text"))), lambda line: strip(line)), lambda line: line != ""
    )
    found = let(
        filled,
        lambda lines: F.struct(
            _first_chars(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), title_chars).alias("title"),
            _abstract(lines, abstract_chars).alias("abstract"),
        ),
    )
    return (
        docs.withColumn("_metadata", found)
        .withColumn("title", F.col("_metadata.title"))
        .withColumn("abstract", F.col("_metadata.abstract"))
        .drop("_metadata")
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Documents out of page rows: page texts joined by line breaks, in page order."""
    in_order = F.array_sort(F.collect_list(F.struct("page_number", "text", "n_images")))
    return (
        pages.groupBy("document_id")
        .agg(in_order.alias("pages"))
        .withColumn("text", F.array_join(F.transform("pages", lambda p: p.text), "\n"))
    )


def parse_documents(pages: DataFrame) -> DataFrame:
    """Pages to one row per document with sections, references, tables, figures, metadata and Markdown."""

    def page_tables(p: Column) -> Column:
        return F.transform(
            pipe_tables_of(p.text),
            lambda t: F.struct(p.page_number.alias("page_number"), t.headers.alias("headers"), t.rows.alias("rows")),
        )

    def page_figures(p: Column) -> Column:
        def images(found: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), p.n_images.cast("int") - 1),
                lambda i: F.struct(
                    p.page_number.alias("page_number"),
                    i.alias("image_index"),
                    F.coalesce(F.get(found, i), F.lit("")).alias("caption"),
                ),
            )

        return F.when(p.n_images > 0, let(captions_of(p.text), images)).otherwise(
            F.array().cast("array<struct<page_number:int,image_index:int,caption:string>>")
        )

    docs = with_metadata(with_sections(assemble_pages(pages.withColumn("page_number", F.col("page_number").cast("int")))))
    parsed = (
        docs.withColumn("references", references_of(F.col("text")))
        .withColumn("tables", F.flatten(F.transform("pages", page_tables)))
        .withColumn("figures", F.flatten(F.transform("pages", page_figures)))
        .withColumn(
            "ocr_required",
            F.exists("pages", lambda p: (F.length(strip(p.text)) < 50) & (p.n_images > 0)),
        )
        .withColumn("total_pages", F.size("pages"))
        .withColumn("total_characters", F.length("text"))
        .drop("pages")
    )
    return parsed.withColumn("markdown", to_markdown())


def to_markdown() -> Column:
    """Markdown of a parsed document row (title, abstract, sections, tables, figures, references)."""
    section_parts = F.flatten(
        F.transform(
            "sections",
            lambda s: F.array(
                F.concat(F.repeat(F.lit("#"), F.least(s.level + 1, F.lit(6))), F.lit(" "), s.heading, F.lit("\n")),
                F.concat(strip(s.content), F.lit("\n")),
            ),
        )
    )
    table_parts = F.transform("tables", lambda t: F.concat(table_markdown(t.headers, t.rows), F.lit("\n")))
    figure_parts = F.flatten(
        F.transform(
            "figures",
            lambda f: F.array_compact(
                F.array(
                    F.concat(
                        F.lit("!["),
                        F.when(f.caption == "", F.lit("(untitled)")).otherwise(f.caption),
                        F.lit("](figure_"),
                        f.page_number.cast("string"),
                        F.lit("_"),
                        f.image_index.cast("string"),
                        F.lit(".png)"),
                    ),
                    F.when(f.caption != "", F.concat(F.lit("\n\n*"), f.caption, F.lit("*"))),
                    F.lit("\n"),
                )
            ),
        )
    )
    reference_parts = F.transform(
        "references",
        lambda r, i: F.concat(
            F.lit("["),
            F.when(r["index"] == "", (i + 1).cast("string")).otherwise(r["index"]),
            F.lit("] "),
            r.raw_text,
            F.lit("\n"),
        ),
    )
    none = F.array().cast("array<string>")

    def titled(title: str, parts: Column) -> Column:
        return F.when(F.size(parts) > 0, F.concat(F.array(F.lit(title)), parts)).otherwise(none)

    return F.array_join(
        F.concat(
            F.when(F.col("title") != "", F.array(F.concat(F.lit("# "), F.col("title"), F.lit("\n")))).otherwise(none),
            F.when(
                F.col("abstract") != "",
                F.array(F.lit("## Abstract\n"), F.concat(F.col("abstract"), F.lit("\n"))),
            ).otherwise(none),
            section_parts,
            titled("## Tables\n", table_parts),
            titled("## Figures\n", figure_parts),
            titled("## References\n", reference_parts),
        ),
        "\n",
    )


def extraction_stats(parsed: DataFrame) -> DataFrame:
    """Counts per parsed document. ``errors`` (array), when present, turns the status to partial."""
    n_errors = F.size("errors") if "errors" in parsed.columns else F.lit(0)
    return parsed.select(
        "document_id",
        "total_pages",
        "total_characters",
        F.size("sections").alias("sections_found"),
        F.size("references").alias("references_found"),
        F.size("tables").alias("tables_found"),
        F.size("figures").alias("figures_found"),
        "ocr_required",
        F.when(F.col("text").isNull(), "failed")
        .when(n_errors > 0, "partial")
        .otherwise("completed")
        .alias("status"),
    )
