"""Citation edges from parsed references: the fields of a reference string, and the work that it names.

A reference is linked by its DOI; without one that is known, by its title: two titles agree if they are equal once a
word is taken out of either, and their years are close. Titles meet on keys, each a hash of the title or of what is
left without one of its words, so nothing is compared that does not agree. Works are reduced to the first of each key
and year before they meet references, so a title of many works costs no more than one of a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.functions.text import blank_to_null, canonical_doi, let, normalize_title, strip
from paperlake.session import cut_lineage

LEAST_WORDS = 3  # of a title that links
YEARS = 1  # by which a year may be off, as for a paper that was online first

# a point ends a field unless it stands after an initial that follows a comma or another such initial
_FIELD_BREAK = r"(?<!,\s[A-Z])(?<!,\s[A-Z]\.\s?[A-Z])[.?]\s+"
_DOI_TAIL = r"(?i)\s*(?:doi:?\s*|https?://(?:dx\.)?doi\.org/)10\.\d{4,9}/\S+"
_YEAR_ONLY = r"^\(?\d{4}[a-z]?\)?$"


def _plain(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, _DOI_TAIL, ""))


def _parts(raw: Column) -> Column:
    return F.filter(
        F.transform(F.split(_plain(raw), _FIELD_BREAK), lambda p: F.rtrim(strip(p), F.lit("."))),
        lambda p: (p != "") & ~p.rlike(_YEAR_ONLY),
    )


def fields_of(raw: Column, quoted: Column) -> Column:
    """(authors, title, journal, volume, issue, first_page, last_page) of a reference; null where it has none.

    ``quoted`` is a title found in quotes, or empty. Else the first field is the authors, the second the title.
    """
    plain = _plain(raw)

    def described(p: Column) -> Column:
        named = F.coalesce(quoted, F.lit("")) != ""
        before = strip(F.regexp_replace(F.substring_index(F.regexp_replace(raw, "[“”]", '"'), '"', 1), r"[.,]\s*$", ""))
        after = F.element_at(F.split(F.regexp_replace(plain, "[“”]", '"'), '"'), -1)
        third = F.when(named, strip(F.regexp_replace(after, r"^[\s.,]+", ""))).otherwise(F.get(p, F.lit(2)))
        some = lambda pattern, group: blank_to_null(F.regexp_extract(plain, pattern, group))
        pages = r"(\d+)\s*[-–]\s*(\d+)\s*\.?\s*$"
        volume = r"(\d+)\s*\((\d+)\)"
        return F.struct(
            blank_to_null(F.when(named, before).when(F.size(p) > 1, F.get(p, F.lit(0)))).alias("authors"),
            _title_field(p, quoted).alias("title"),
            blank_to_null(F.regexp_replace(F.regexp_extract(third, r"^([^\d(]*)", 1), r"[,\s]+$", "")).alias("journal"),
            some(volume, 1).alias("volume"), some(volume, 2).alias("issue"),
            some(pages, 1).alias("first_page"), some(pages, 2).alias("last_page"),
        )

    return let(_parts(raw), described)


def _title_field(parts: Column, quoted: Column) -> Column:
    """The title among the ``parts`` of a reference: in quotes, else the second field, or the only one."""
    named = F.coalesce(quoted, F.lit("")) != ""
    return blank_to_null(F.when(named, quoted).when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))


def segmented(references: DataFrame) -> DataFrame:
    """References (raw_text, title, ...) with ``fields``, and with the title of the fields where none was in quotes."""
    raw, quoted = F.col("raw_text"), F.col("title")
    # not taken from ``fields``, so that those who want titles only need not find the other fields
    title = F.coalesce(blank_to_null(quoted), let(_parts(raw), lambda p: _title_field(p, quoted)))
    return references.withColumn("fields", fields_of(raw, quoted)).withColumn("title", title)


def _title(title: Column) -> Column:
    """A title as its normalised words; null if they are too few to link."""
    words = F.filter(F.split(normalize_title(title), " "), lambda w: w != "")
    return let(words, lambda w: F.when(F.size(w) >= LEAST_WORDS, F.array_join(w, " ")))


def _title_keys(df: DataFrame, *kept: str) -> DataFrame:
    """One row per key of a ``_title``: the hash of all its words, with 0 words missing, or of all but one, with 1."""

    def keys(words: Column) -> Column:
        whole = F.struct(F.lit(0).alias("missing"), F.xxhash64(F.array_join(words, " ")).alias("key"))
        without = F.transform(
            words,
            lambda _, i: F.struct(
                F.lit(1).alias("missing"),
                F.xxhash64(F.array_join(F.concat(F.slice(words, 1, i), F.slice(words, i + 2, F.size(words))), " ")).alias("key"),
            ),
        )
        return F.array_distinct(F.concat(F.array(whole), without))

    listed = df.where("_title IS NOT NULL").select(*kept, "_title")
    return explode_once(listed, let(F.split("_title", " "), keys), "_k").select(*kept, "_k.missing", "_k.key")


def link_references(references: DataFrame, works: DataFrame, years: int = YEARS) -> DataFrame:
    """(document_id, position, cited_id, by, missing) for each reference that names a work of ``works`` (seq, doi, title, year).

    ``by`` is "doi" or "title", ``missing`` the number of words taken out for the titles to agree. Of several works
    the one with the fewest such words wins, then that of the closest year, then the first by ``seq``; an unknown year
    is no hindrance and counts as the farthest allowed. References without a DOI and with a title of fewer than
    ``LEAST_WORDS`` words link with nothing.
    """
    asked = references.select(
        "document_id", "position", blank_to_null(canonical_doi(F.col("doi"))).alias("_doi"), _title(F.col("title")).alias("_title"), "year"
    )
    asked = cut_lineage(asked)  # references are parsed once
    by_doi = works.select(blank_to_null(canonical_doi(F.col("doi"))).alias("_doi"), "seq").where("_doi IS NOT NULL")
    first = by_doi.groupBy("_doi").agg(F.min("seq").alias("cited_id"))
    # references without a DOI stay out of the join, where all of them would meet in one task
    known = asked.where("_doi IS NOT NULL").join(first, "_doi", "left")
    exact = known.where("cited_id IS NOT NULL").select(
        "document_id", "position", "cited_id", F.lit("doi").alias("by"), F.lit(0).alias("missing")
    )
    columns = ("document_id", "position", "_title", "year")
    rest = known.where("cited_id IS NULL").select(*columns).unionByName(asked.where("_doi IS NULL").select(*columns))
    rest = rest.where("_title IS NOT NULL").withColumn("_name", F.xxhash64("_title"))
    # a title of many references, or of many works, is looked up once for each year
    names = rest.groupBy("_name", F.col("year").alias("my_year")).agg(F.first("_title").alias("_title"))
    wanted = _title_keys(names, "_name", "my_year").withColumnRenamed("missing", "mine")
    titles = works.select("seq", _title(F.col("title")).alias("_title"), "year").groupBy("_title", "year").agg(F.min("seq").alias("seq"))
    held = _title_keys(titles, "seq", "year")
    held = held.groupBy("key", "year").agg(F.min(F.struct("missing", "seq")).alias("w")).select("key", "year", "w.*")
    apart = F.coalesce(F.abs(F.col("year") - F.col("my_year")), F.lit(years))
    met = wanted.join(held, "key").withColumn("apart", apart).where(F.col("apart") <= years)
    best = met.groupBy("_name", "my_year").agg(F.min(F.struct((F.col("mine") + F.col("missing")).alias("missing"), "apart", "seq")).alias("b"))
    found = rest.join(best.withColumnRenamed("_name", "_of"), (F.col("_name") == F.col("_of")) & F.col("year").eqNullSafe(F.col("my_year")))
    titled = found.groupBy("document_id", "position").agg(F.min("b").alias("b")).select(
        "document_id", "position", F.col("b.seq").alias("cited_id"), F.lit("title").alias("by"), F.col("b.missing").alias("missing")
    )
    return exact.unionByName(titled)


def citation_edges(links: DataFrame) -> DataFrame:
    """Edges for ``citation_expansion`` and ``reference_expansion``: each cited work once per citing one, where it stands first."""
    edges = links.groupBy(F.col("document_id").alias("citing_id"), "cited_id").agg(F.min("position").alias("position"))
    return edges.where("citing_id <> cited_id")
