"""Map raw records of bibliographic sources to one article schema.

Input is a frame with a string column ``record`` (one JSON object per row, as
``spark.read.text`` gives). Fields that come in more than one shape are read as
raw JSON strings and resolved with expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import blank_to_null, let, strip
from paperlake.session import cut_lineage

SCALARS = (
    "title", "journal", "year", "doi", "pmid", "abstract", "url", "pdf_url", "pmcid", "language", "publisher",
    "volume", "issue", "pages", "license",
)
LISTS = ("authors", "keywords", "mesh_terms", "publication_type")

_PUBMED = """uid string, title string, fulljournalname string, source string, pubdate string,
authors array<struct<name:string>>, articleids array<struct<idtype:string,value:string>>, abstracttext string,
keywords array<string>, meshterms array<string>, pubtype array<string>, lang string, publishername string,
volume string, issue string, pages string, fulltexturl array<struct<content:string,url:string>>, _corrupt string"""

_EUROPEPMC = """title string, authorString string,
journalInfo struct<journal:string,volume:string,issue:string,year:string>, pubYear string, doi string,
pmid string, pmcid string, abstractText string, keywordList string, meshTermList string,
fullTextUrlList struct<fullTextUrl:array<struct<documentStyle:string,url:string>>>, fullTextUrl string,
language string, pubType string, pageInfo string, license string, _corrupt string"""

_OPENALEX = """id string, title string, publication_year int, doi string,
authorships array<struct<author:struct<display_name:string>>>,
host_venue struct<display_name:string,publisher:string,volume:string,issue:string,pages:string>,
ids struct<doi:string,pmid:string,pmcid:string>, abstract_inverted_index map<string,array<int>>,
keywords array<struct<display_name:string>>,
mesh array<struct<descriptor_name:string,display_name:string>>, concepts array<struct<display_name:string>>,
best_oa_location struct<pdf_url:string,landing_page_url:string,license:string>,
oa_locations array<struct<pdf_url:string>>, type string, language string, _corrupt string"""


def _parse(raw: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # a generated column is not inlined, so a filter on it does not parse the record again
    parsed = raw.select("*", F.explode_outer(F.array(F.from_json("record", schema, options))).alias("r"))
    return parsed.withColumn("bad_record", F.col("r._corrupt"))


def _filled(col: Column) -> Column:
    """The non-empty strings of a list; an empty list for null."""
    kept = F.filter(col, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))


def _single(col: Column) -> Column:
    return F.when(blank_to_null(col).isNotNull(), F.array(col)).otherwise(F.array().cast("array<string>"))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _json_items(value: Column, wrapper: str, keys: tuple[str, ...]) -> Column:
    """Strings of a list given as ``[..]`` or ``{wrapper: [..]}``, whose items are strings or objects."""
    inner = F.when(value.startswith("{"), F.get_json_object(value, f"$.{wrapper}")).otherwise(value)

    def item(x: Column) -> Column:
        picked = F.coalesce(*[blank_to_null(F.get_json_object(x, f"$.{k}")) for k in keys], F.lit(""))
        return F.when(x.startswith("{"), picked).otherwise(x)

    return _filled(F.transform(F.from_json(inner, "array<string>"), item))


def _article(parsed: DataFrame, source: str, columns: Mapping[str, Column]) -> DataFrame:
    names = [*SCALARS, *LISTS]
    kept = [c for c in parsed.columns if c not in ("record", "r", *names)]
    return parsed.select(
        *kept,
        *[columns.get(n, F.lit(None).cast("string")).alias(n) for n in names],
        F.lit(source).alias("source"),
        F.array(F.lit(source)).alias("provenance"),
    )


def normalize_pubmed(raw: DataFrame) -> DataFrame:
    parsed = _parse(raw, _PUBMED)
    r = lambda name: F.col(f"r.{name}")

    def article_id(kind: str) -> Column:
        # the last id of a kind counts
        return F.element_at(
            F.concat(
                F.array(F.lit(None).cast("string")),
                F.transform(
                    F.filter(F.coalesce(r("articleids"), F.array().cast("array<struct<idtype:string,value:string>>")),
                             lambda a: a.idtype == kind),
                    lambda a: a.value,
                ),
            ),
            -1,
        )

    pmid = F.coalesce(article_id("pubmed"), r("uid"))
    parts = F.transform(
        F.from_json(r("abstracttext"), "array<string>"),
        lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p),
    )
    abstract = F.when(r("abstracttext").startswith("["), F.array_join(parts, " ")).otherwise(r("abstracttext"))
    language = F.when(
        r("lang").startswith("["), F.get(F.from_json(r("lang"), "array<string>"), F.lit(0))
    ).otherwise(r("lang"))
    pdf = F.filter(
        r("fulltexturl"), lambda u: (u.content == "pdf") & blank_to_null(u.url).isNotNull()
    )
    return _article(
        parsed,
        "pubmed",
        {
            "title": r("title"),
            "journal": F.coalesce(blank_to_null(r("fulljournalname")), r("source")),
            "year": blank_to_null(F.regexp_extract(r("pubdate"), r"(\d{4})", 1)).cast("int"),
            "doi": article_id("doi"),
            "pmid": pmid,
            "pmcid": article_id("pmc"),
            "abstract": abstract,
            "url": F.when(
                blank_to_null(pmid).isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))
            ),
            "pdf_url": _first(F.transform(pdf, lambda u: u.url)),
            "language": language,
            "publisher": r("publishername"),
            "volume": r("volume"),
            "issue": r("issue"),
            "pages": r("pages"),
            "authors": _filled(F.transform(r("authors"), lambda a: a["name"])),
            "keywords": _or_empty(r("keywords")),
            "mesh_terms": _or_empty(r("meshterms")),
            "publication_type": _or_empty(r("pubtype")),
        },
    )


def normalize_europepmc(raw: DataFrame) -> DataFrame:
    parsed = _parse(raw, _EUROPEPMC)
    r = lambda name: F.col(f"r.{name}")
    journal = r("journalInfo.journal")
    nested = journal.startswith("{")
    pdf = F.filter(
        r("fullTextUrlList.fullTextUrl"),
        lambda u: (u.documentStyle == "PDF") & blank_to_null(u.url).isNotNull(),
    )
    return _article(
        parsed,
        "europepmc",
        {
            "title": r("title"),
            "journal": F.when(nested, F.get_json_object(journal, "$.title")).otherwise(journal),
            "publisher": F.when(nested, F.get_json_object(journal, "$.publisher")),
            "year": blank_to_null(F.coalesce(r("pubYear"), r("journalInfo.year"))).try_cast("int"),
            "doi": r("doi"),
            "pmid": r("pmid"),
            "pmcid": r("pmcid"),
            "abstract": r("abstractText"),
            "url": F.coalesce(
                blank_to_null(r("fullTextUrl")),
                F.when(
                    blank_to_null(r("pmid")).isNotNull(),
                    F.concat(F.lit("https://europepmc.org/article/MED/"), r("pmid")),
                ),
            ),
            "pdf_url": _first(F.transform(pdf, lambda u: u.url)),
            "language": r("language"),
            "volume": r("journalInfo.volume"),
            "issue": r("journalInfo.issue"),
            "pages": r("pageInfo"),
            "license": r("license"),
            "authors": _filled(F.transform(F.split(r("authorString"), ","), lambda a: strip(a))),
            "keywords": _json_items(r("keywordList"), "keyword", ("value", "term")),
            "mesh_terms": _json_items(r("meshTermList"), "meshTerm", ("term", "descriptorName")),
            "publication_type": _single(r("pubType")),
        },
    )


def rebuild_abstract(index: Column) -> Column:
    """Text out of a word -> positions index; on a shared position the last word stays, gaps are skipped."""
    entries = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e, i: F.transform(
                e.value, lambda p: F.struct(p.alias("position"), i.alias("entry"), e.key.alias("word"))
            ),
        )
    )

    def last_per_position(ordered: Column) -> Column:
        kept = F.filter(
            F.transform(
                ordered,
                lambda x, i: F.struct(
                    x.word.alias("word"), F.get(ordered, i + 1).position.alias("next"), x.position.alias("position")
                ),
            ),
            lambda x: x.next.isNull() | (x.next != x.position),
        )
        return F.array_join(F.transform(kept, lambda x: x.word), " ")

    return F.when(F.size(index) > 0, let(F.array_sort(entries), last_per_position))


def normalize_openalex(raw: DataFrame) -> DataFrame:
    parsed = _parse(raw, _OPENALEX)
    r = lambda name: F.col(f"r.{name}")
    names = lambda items: _filled(F.transform(items, lambda x: x.display_name))
    mesh = _filled(
        F.transform(r("mesh"), lambda m: F.coalesce(blank_to_null(m.descriptor_name), m.display_name))
    )
    doi = F.coalesce(blank_to_null(r("doi")), r("ids.doi"))
    return _article(
        parsed,
        "openalex",
        {
            "title": r("title"),
            "journal": r("host_venue.display_name"),
            "year": r("publication_year"),
            "doi": doi,
            "pmid": r("ids.pmid"),
            "pmcid": r("ids.pmcid"),
            "abstract": rebuild_abstract(r("abstract_inverted_index")),
            "url": F.coalesce(
                blank_to_null(r("best_oa_location.landing_page_url")),
                blank_to_null(r("id")),
                F.when(blank_to_null(doi).isNotNull(), F.concat(F.lit("https://doi.org/"), doi)),
            ),
            "pdf_url": F.coalesce(
                blank_to_null(r("best_oa_location.pdf_url")),
                _first(_filled(F.transform(r("oa_locations"), lambda o: o.pdf_url))),
            ),
            "language": r("language"),
            "publisher": r("host_venue.publisher"),
            "volume": r("host_venue.volume"),
            "issue": r("host_venue.issue"),
            "pages": r("host_venue.pages"),
            "license": r("best_oa_location.license"),
            "authors": names(F.transform(r("authorships"), lambda a: a.author)),
            "keywords": names(r("keywords")),
            "mesh_terms": F.when(F.size(mesh) > 0, mesh).otherwise(names(r("concepts"))),
            "publication_type": _single(r("type")),
        },
    )


_SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pubmed": normalize_pubmed,
    "europepmc": normalize_europepmc,
    "openalex": normalize_openalex,
}


def register_source(name: str, normalize: Callable[[DataFrame], DataFrame]) -> None:
    _SOURCES[name] = normalize


def load_articles(
    raw: Mapping[str, DataFrame], columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Union of all sources as (articles, quarantined records, skipped sources with the reason).

    Records that do not parse are quarantined. A source whose mapping does not
    fit its columns is skipped, and the others still load. Where only some
    ``columns`` of the articles are wanted, these are kept in reliable storage:
    articles and quarantine then come from one reading of all records.
    """
    frames, skipped = [], {}
    for name, frame in raw.items():
        try:
            frames.append(_SOURCES[name](frame))
        except KeyError:
            skipped[name] = "unknown source"
        except AnalysisException as error:
            skipped[name] = str(error).splitlines()[0]
    if not frames:
        raise ValueError(f"no source could be read: {skipped}")
    everything = frames[0]
    for frame in frames[1:]:
        everything = everything.unionByName(frame, allowMissingColumns=True)
    if columns is not None:
        everything = cut_lineage(everything.select(*columns, *[c for c in ("source", "bad_record") if c not in columns]))
    bad = F.col("bad_record").isNotNull()
    return everything.where(~bad).drop("bad_record"), everything.where(bad).select("source", "bad_record"), skipped
