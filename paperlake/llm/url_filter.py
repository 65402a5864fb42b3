"""URL filters by a bit-parallel wildcard automaton (operator 10).

Glob rules become positions of one Shift-And automaton, packed into 64-bit
words. One step reads one byte of every URL of a batch and moves all patterns
of all URLs at once; NumPy runs the step over the batch.

Globs: ``?`` is one byte, ``*`` a run without "/", ``**`` any run.

Defined results: host and path come from the URL alone (null, or without "://":
both empty, no rule fits); matching is by bytes, host lower-cased in A-Z only;
of the fitting rules the longest wins, of equally long ones a block before
an allow, then the earlier one. Where no rule fits, the first fitting glob of
those that block decides; where none does, the default verdict.
Repeated rows are judged alike, an empty table gives no rows, input columns
named like an added one are replaced.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY, RUN, DEEP_RUN = "?", "*", "**"
# Globs that block where no rule decides, over host and path: a run without "/" first keeps a word to the host.
SPAM_GLOBS = (
    "*casino**", "*poker**", "*lottery**", "*-bets**", "*bets-**", "*pills**", "*viagra**", "*payday**", "*replica**",
    "*spam**", "*porn**", "**/wp-login.php", "**/wp-admin/**", "**/cgi-bin/**", "**.exe", "**.apk",
)
BATCH_URLS = 20_000


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[list]:
        literal = list((self.host + self.path).encode())
        return [[*literal, DEEP_RUN], [RUN, ord("."), *literal, DEEP_RUN]]


def parse_glob(glob: str) -> list:
    """A glob as a list of byte values and wildcards."""
    elements: list = []
    at = 0
    while at < len(glob):
        if glob.startswith(DEEP_RUN, at):
            elements.append(DEEP_RUN)
            at += 2
        else:
            elements += [glob[at]] if glob[at] in (ANY, RUN) else list(glob[at].encode())
            at += 1
    return elements


class Automaton:
    """All globs side by side. Bit k of a glob says that its first k elements, runs not counted, have been read."""

    def __init__(self, globs: Sequence[list]):
        bits = sum(1 + sum(e not in (RUN, DEEP_RUN) for e in g) for g in globs)
        self.n_words = -(-max(bits, 1) // 64)
        enter = np.zeros((256, self.n_words * 64), dtype=bool)  # the byte moves a pattern on to this bit
        stay = np.zeros_like(enter)  # the byte keeps this bit, inside a run
        start, self.last = np.zeros(self.n_words * 64, dtype=bool), []
        bit = 0
        for glob in globs:
            start[bit] = True
            for element in glob:
                if element == DEEP_RUN:
                    stay[:, bit] = True
                elif element == RUN:
                    stay[np.arange(256) != ord("/"), bit] = True
                else:
                    bit += 1
                    enter[slice(None) if element == ANY else element, bit] = True
            self.last.append(bit)
            bit += 1
        pack = lambda m: np.packbits(m, axis=-1, bitorder="little").view(np.uint64)
        self.enter, self.stay, self.start = pack(enter), pack(stay), pack(start)

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, which globs match it whole."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        at, sizes = offsets[:-1][order], sizes[order]
        state = np.tile(self.start, (len(sizes), 1))
        one, top = np.uint64(1), np.uint64(63)
        live = len(sizes)
        for step in range(int(sizes[0]) if live else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))  # texts longer than ``step``
            byte, now = data[at[:live] + step], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.enter[byte]) | (now & self.stay[byte])
        found = np.empty((len(sizes), len(self.last)), dtype=bool)
        for k, bit in enumerate(self.last):
            found[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one
        return found


def _host_and_path(url: Column) -> tuple[Column, Column]:
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    df: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow", blocked: Sequence[str] = ()
) -> DataFrame:
    """``df`` with host, path, rule (of the rule that decides, else null), verdict and pattern (the glob that
    decides, else null).

    ``blocked`` are globs over host and path that block where no rule fits.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block"))
    globs = [*(g for r in ranked for g in r.globs()), *(parse_glob(g) for g in blocked)]
    host, path = _host_and_path(F.col(url_col))
    parts = df.withColumns({"host": host, "path": path})
    added = ("rule", "verdict", "pattern")
    kept = [f for f in parts.schema.fields if f.name not in added]
    out = T.StructType([*kept, *(T.StructField(name, T.StringType()) for name in added)])

    def run(batches):
        automaton = Automaton(globs)
        names = pa.array([r.name for r in ranked], pa.string())
        verdicts = pa.array([*(r.verdict for r in ranked), *("block" for _ in blocked), default], pa.string())
        written = pa.array(blocked, pa.string())
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_URLS):
                part = batch.slice(first, BATCH_URLS)
                whole = pc.binary_join_element_wise(part.column("host"), part.column("path"), "").cast(pa.large_string())
                offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[: len(whole) + 1]
                data = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)
                found = automaton.match(data, offsets) & (np.diff(offsets) > 0)[:, None]
                by_rule = found[:, : 2 * len(ranked)].reshape(len(whole), len(ranked), 2).any(axis=2)
                fits = np.concatenate([by_rule, found[:, 2 * len(ranked) :]], axis=1)  # what comes first decides
                some = fits.any(axis=1)
                rank = np.where(some, fits.argmax(axis=1) if fits.shape[1] else 0, fits.shape[1])
                ruled = rank < len(ranked)
                rule = names.take(pa.array(rank, mask=~ruled))
                glob = written.take(pa.array(rank - len(ranked), mask=ruled | ~some))
                columns = [*(part.column(f.name) for f in kept), rule, verdicts.take(pa.array(rank)), glob]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return parts.select(*(f.name for f in kept)).mapInArrow(run, out)


def glob_pattern(glob: str) -> str:
    """A regular expression for the same texts, of characters in place of bytes."""
    wild = {ANY: ".", RUN: "[^/]*", DEEP_RUN: ".*"}
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "(?s)" + "".join(wild.get(p) or re.escape(p) for p in parts if p)


def rules_sql(rules: Sequence[Rule], default: str = "allow", blocked: Sequence[str] = ()) -> str:
    """The same judgement as SQL over ``pages``, for comparison."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block"))
    fits = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in ranked
    ]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)
    globs = " ".join(f"WHEN host || path <> '' AND regexp_full_match(host || path, '{glob_pattern(g)}') THEN '{g}'" for g in blocked)
    glob = f"CASE WHEN rule IS NULL THEN CASE {globs} END END" if blocked else "NULL::VARCHAR"
    return f"""
        WITH rests AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rests),
        ruled AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruling FROM parts),
        judged AS (SELECT *, {glob} AS pattern FROM ruled)
        SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE '{default}' END) AS verdict, pattern
        FROM judged"""
