"""Column functions over titles, identifiers and running text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        "
    "        　"
)
SPACES = r"(?U)[\s\x1c-\x1f]+"

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once per row.

    A plain column used inside a lambda may be inlined there by the optimizer and
    computed again for every element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(SPACE_CHARS))


def words(col: Column) -> Column:
    """White-space separated words; no words for a blank text."""
    return F.array_remove(F.split(col, SPACES), "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def text_of(*cols: str) -> Column:
    """Columns joined by one space, null read as empty, lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def normalize_title(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "))


def canonical_doi(col: Column) -> Column:
    """Lower case, trimmed, without a resolver prefix."""
    return F.regexp_replace(strip(F.lower(col)), r"^(https?://(dx\.)?doi\.org/|doi:)", "")


def identity_key(col: Column) -> Column:
    return strip(F.lower(col))


def derive_id(doi: Column, pmid: Column, pmcid: Column, title: Column) -> Column:
    return F.coalesce(
        F.when(blank_to_null(doi).isNotNull(), identity_key(doi)),
        F.when(blank_to_null(pmid).isNotNull(), F.concat(F.lit("pmid:"), pmid)),
        F.when(blank_to_null(pmcid).isNotNull(), F.concat(F.lit("pmcid:"), identity_key(pmcid))),
        F.concat(F.lit("title:"), identity_key(F.coalesce(title, F.lit("")))),
    )


def _literals(items: Iterable[str]) -> Column:
    """One literal array: the plan stays flat however many entries there are."""
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """Whether any of the needles occurs; null for a null text, as ``contains`` is."""
    return let(text, lambda t: F.exists(_literals(needles), lambda n: F.contains(t, n)))


def matches_any(text: Column, patterns: Iterable[str]) -> Column:
    """Whether any of the patterns matches, tested as one alternation."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return text.rlike(joined) if joined else F.lit(False)


def count_hits(text: Column, needles: Iterable[str]) -> Column:
    """How many of the needles occur, each counted once."""
    return let(text, lambda t: F.size(F.filter(_literals(needles), lambda n: F.contains(t, n))))


def labels_where(conditions: Mapping[str, Column]) -> Column:
    """The labels whose condition holds, in the given order."""
    if not conditions:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for label, c in conditions.items()]))


def round_even(col: Column, digits: int) -> Column:
    """Round to ``digits`` with halves to even, on the binary value."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale
