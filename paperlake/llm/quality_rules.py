"""Line-first quality rules (operator 7), in column expressions only.

Each line is judged by itself: punctuation (symbols, exclamation marks and
capitals beyond a share of its characters), navigation (separators between
entries) and boilerplate (known phrases, or a long line that repeats an earlier
one). Failing lines are removed; a document that loses too much of its text
is rejected, and so is one that fails the base rules.

Defined results: a null or empty text has zero counts, fails the base rules and
is not kept. Words are longest runs of characters other than 0x20 and
0x09-0x0D. Repeated rows are judged alike; an empty table gives no rows; input
columns named like an added one are replaced, all others stay. Work per text is
at most n log n in its words.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import let

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
WORD = r"[^\x20\x09-\x0D]+"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "use cookies", "cookie policy",
    "enable javascript", "lorem ipsum", "click here", "read more", "subscribe to our", "sign up for", "log in to",
    "share on facebook", "share on twitter", "skip to content", "back to top", "powered by",
)


@dataclass(frozen=True)
class LineRules:
    """Shares are of a line's characters outside white space; ``keep_share`` is of a document's."""

    symbols: float = 0.05
    exclamations: float = 0.08
    capitals: float = 0.6
    capitals_from: int = 20
    separators: float = 0.06
    repeated_from: int = 25
    keep_share: float = 0.6
    min_words: int = 50
    phrases: tuple[str, ...] = BOILERPLATE


def _solid(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def _has_any(text: Column, needles: Iterable[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(n)) for n in needles), F.lit(False))


def _suspicious(text: Column, n_symbols: Column, rules: LineRules) -> Column:
    """False only where no line of the text can fail by itself: a cheap test that saves judging each line."""
    return (
        (n_symbols > 0)
        | _has_any(text, "!" + SEPARATORS[1:])
        | text.rlike(r"\p{Lu}{2}")
        | _has_any(F.lower(text), rules.phrases)
    )


def _line_fails(line: Column, rules: LineRules) -> Column:
    def judge(chars: Column) -> Column:
        capitals = F.when(line.rlike(r"\p{Lu}{2}"), F.regexp_count(line, F.lit(r"\p{Lu}"))).otherwise(0)
        punctuation = (
            (F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) > chars * rules.symbols)
            | (F.regexp_count(line, F.lit("!")) > chars * rules.exclamations)
            | ((chars >= rules.capitals_from) & (capitals > chars * rules.capitals))
        )
        navigation = F.regexp_count(line, F.lit(f"[{SEPARATORS}]")) > chars * rules.separators
        return punctuation | navigation | _has_any(F.lower(line), rules.phrases)

    return let(_solid(line), judge)


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more in the array."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def twice(by_hash: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        found = F.filter(
            by_hash, lambda x, k: same(x, F.get(by_hash, k + 1)) | same(x, F.get(by_hash, F.greatest(k, F.lit(1)) - 1)) & (k > 0)
        )
        return let(F.array_sort(F.transform(found, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(by_hash, twice))

    return F.when(F.size(words) < 4, 0).otherwise(let(windows, count))


def judge_quality(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), cleaned_col: str = "cleaned") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the cleaned text.

    The cleaned text is the text itself when no line fails, null when it is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            repeated_words(w).cast("long").alias("repeated"),
        ),
    )
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", cleaned_col)
    kept = [c for c in df.columns if c not in added or c == text_col]
    symbols = F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")
    counted = df.select(*kept, counts.alias("_words"), symbols.alias("n_symbols"))

    def judged(suspicious: Column) -> Column:
        return F.transform(
            F.split(text, "\n", -1),
            lambda line, i: F.struct(
                line.alias("line"),
                F.when(suspicious, _line_fails(line, rules)).otherwise(False).alias("fails"),
                # short lines may repeat: only they are told apart by their place
                F.when(F.length(line) >= rules.repeated_from, -1).otherwise(i).alias("place"),
            ),
        )

    def summary(judged: Column) -> Column:
        solid = F.filter(F.transform(judged, lambda x: x["line"]), lambda line: line.rlike(WORD))
        left = F.array_distinct(
            F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: F.struct(x["place"], x["line"]))
        )

        def result(left: Column) -> Column:
            text_left = F.array_join(F.transform(left, lambda x: x["line"]), "\n")
            return F.struct(
                let(solid, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")).alias("dup"),
                F.when(F.size(left) < F.size(judged), text_left).alias("text"),
            )

        return let(left, result)

    by_line = let(_suspicious(text, F.col("n_symbols"), rules), lambda s: let(judged(s), summary))
    measured = counted.withColumn("_lines", by_line).select(
        *kept,
        F.col("_words.n").alias("n_words"),
        F.col("_words.chars").alias("word_chars"),
        "n_symbols",
        F.col("_lines.dup").alias("n_dup_lines"),
        F.col("_words.repeated").alias("n_repeat_words"),
        F.when(F.col(text_col).isNotNull(), F.coalesce("_lines.text", text_col)).alias(cleaned_col),
        F.col("_lines.text").isNotNull().alias("_changed"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = ~F.col("_changed") | (_solid(F.col(cleaned_col)) >= F.col("word_chars") * rules.keep_share)
    judged_rows = measured.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)
    return judged_rows.select(*kept, *added)


def quality_sql(rules: LineRules = LineRules()) -> str:
    """The contract's columns as SQL over ``documents``, for comparison."""
    quoted = "|".join(rules.phrases)
    solid = lambda x: f"length(translate({x}, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), ''))"
    count = lambda x, c: f"(length({x}) - length(translate({x}, '{c}', '')))"
    return rf"""
        WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l FROM texts),
        counts AS (
            SELECT doc_id, len(w) AS n_words, {solid('text')} AS word_chars, {count('text', SYMBOLS)} AS n_symbols,
                   len(list_filter(l, lambda x: {solid('x')} > 0)) - len(list_distinct(list_filter(l, lambda x: {solid('x')} > 0))) AS n_dup_lines
            FROM words),
        windows AS (
            SELECT doc_id, i, w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] AS win
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM words),
        sized AS (SELECT doc_id, line, i, {solid('line')} AS chars FROM lines),
        judged AS (
            SELECT doc_id, line, i, chars,
                   {count('line', SYMBOLS)} > chars * {rules.symbols} OR {count('line', '!')} > chars * {rules.exclamations}
                   OR (chars >= {rules.capitals_from} AND regexp_matches(line, '\p{{Lu}}{{2}}') AND length(regexp_replace(line, '\P{{Lu}}', '', 'g')) > chars * {rules.capitals})
                   OR {count('line', SEPARATORS)} > chars * {rules.separators}
                   OR regexp_matches(lower(line), '{quoted}') AS fails
            FROM sized),
        survivors AS (
            SELECT DISTINCT doc_id, CASE WHEN length(line) >= {rules.repeated_from} THEN -1 ELSE i END AS place, line, chars
            FROM judged WHERE NOT fails),
        remains AS (SELECT doc_id, sum(chars) AS n FROM survivors GROUP BY doc_id),
        based AS (
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                   n_words < {rules.min_words} OR 100 * coalesce(covered.n, 0) > 50 * n_words AS base_failed,
                   coalesce(remains.n, 0) AS remaining
            FROM counts LEFT JOIN covered USING (doc_id) LEFT JOIN remains USING (doc_id))
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND remaining >= word_chars * {rules.keep_share} AS kept
        FROM based"""
