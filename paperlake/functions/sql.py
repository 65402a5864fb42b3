"""SQL functions for users of ``spark.sql``; all are inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

from paperlake.fixed_values import STUDY_DESIGN_RULES


def _design_case() -> str:
    rules = []
    for design, words in STUDY_DESIGN_RULES:
        test = " OR ".join(f"contains(lower(text), '{w}')" for w in words)
        rules.append(f"WHEN {test} THEN '{design}'")
    return "CASE " + " ".join(rules) + " END"


FUNCTIONS = {
    "normalize_title(title STRING) RETURNS STRING": (
        "RETURN trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]+', ' '), ' +', ' '))"
    ),
    "derive_id(doi STRING, pmid STRING, pmcid STRING, title STRING) RETURNS STRING": (
        "RETURN coalesce(nullif(trim(lower(doi)), ''), 'pmid:' || nullif(pmid, ''), "
        "'pmcid:' || nullif(trim(lower(pmcid)), ''), 'title:' || trim(lower(coalesce(title, ''))))"
    ),
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "RETURN CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D "
        "ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
        "(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END"
    ),
    "study_design(text STRING) RETURNS STRING": f"RETURN {_design_case()}",
    "chunk_text(body STRING, size INT, overlap INT) RETURNS TABLE (chunk_index INT, chunk STRING)": (
        # the words are bound to a lambda variable, so a text is split once and not for each of its chunks
        "RETURN SELECT pos, chunk FROM (SELECT element_at(transform(array(array_remove(split(trim(body), '\\\\s+'), '')), "
        "w -> transform(sequence(0, greatest(size(w), 1) - 1, size - overlap), start -> array_join(slice(w, start + 1, size), ' '))), 1) AS c) "
        "LATERAL VIEW OUTER posexplode(c) s AS pos, chunk"
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} {body}")
