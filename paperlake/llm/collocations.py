"""Phrases whose words stand together more often than their parts explain (operator 13).

1. One scan reads the texts. Each task cuts its rows into shards of bounded size and leaves for each the words it
   holds, with counts, and its texts as a stream of codes of these words. No text is shuffled.
2. Words are counted over all shards, by language. A word that occurs less often than a phrase must cannot stand in
   one; the others get ids.
3. Each shard meets the ids of its own words, counts its packed n-grams of ids into counting quotient filters, one
   for each range of permuted keys, and sends these; they are much smaller than the n-grams.
4. Each range merges the sorted filters of all shards. Counts are exact: filters keep whole keys.
5. Phrases that occur often enough are scored by their cuts, which are words or shorter phrases found in 2 and 4.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count as often as they
occur; ties go to the smaller phrase in UTF-8 byte order; an empty table gives no rows; extra columns are ignored.
A word that occurs in every shard brings one row for each, so no key gathers more rows than there are shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.quotient_filter import counted, pack, permute, restore, unpack
from paperlake.llm.textbytes import lowered
from paperlake.session import cut_lineage

SHARD_BYTES = 8 << 20  # of text; a longer text is a shard of its own
RANGE_ENTRIES = 2_000_000  # n-gram occurrences for each range, at most: what its task merges is no more
CODEC = "zstd"

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 32]] = True


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their counts, codes of all words in order with -1 where a piece ends)."""
    data, offsets = lowered(texts)
    cut = _BREAK[data]
    inside = ~(cut | _SPACE[data])
    if not inside.any():
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    starts_text = np.zeros(len(data), dtype=bool)
    starts_text[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & (starts_text | np.concatenate([[True], ~inside[:-1]])))
    after = np.concatenate([starts_text[1:] | ~inside[1:], [True]])
    ends = np.flatnonzero(inside & after) + 1
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(data[inside]))
    words = words.dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int32)
    breaks = np.concatenate([[0], np.cumsum(cut)])
    piece = breaks[starts] + np.searchsorted(offsets, starts, side="right")  # differs where a text or a piece ends
    new = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return words.dictionary, np.bincount(codes, minlength=len(words.dictionary)), np.insert(codes, new, -1)


def _shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows (shard, lang, first, words, counts, codes): the words of a language in a shard, numbered from ``first``."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def shard(batches_):
            table = pa.Table.from_batches(batches_)
            langs = table.column("lang").combine_chunks().dictionary_encode()
            first, streams, rows = 0, [], []
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                mine = table.column("text").filter(pc.equal(langs.indices, code)).combine_chunks()
                words, counts, codes = _coded(mine)
                if not len(words):
                    continue
                rows.append((lang, first, words, counts))
                streams += [np.where(codes < 0, 0, codes + 1 + first), [0]]
                first += len(words)
            if not rows:
                return
            stream = pa.compress(np.concatenate(streams).astype("<u4").tobytes(), codec=CODEC, asbytes=True)
            last = len(rows) - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([(part << 24) + made] * len(rows), pa.int64()),
                    "lang": pa.array([r[0] for r in rows], pa.string()),
                    "first": pa.array([r[1] for r in rows], pa.int32()),
                    "words": pa.array([r[2].to_pylist() for r in rows], pa.list_(pa.string())),
                    "counts": pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    "size": pa.array([first if k == last else None for k in range(len(rows))], pa.int32()),
                    "length": pa.array([sum(map(len, streams)) if k == last else None for k in range(len(rows))], pa.int64()),
                    "codes": pa.array([stream if k == last else None for k in range(len(rows))], pa.binary()),
                }
            )

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            row, before = 0, 0
            while row < batch.num_rows:
                end = min(int(np.searchsorted(ends, before + shard_bytes - size)) + 1, batch.num_rows)
                held.append(batch.slice(row, end - row))
                size += int(ends[end - 1]) - before
                row, before = end, int(ends[end - 1])
                if size >= shard_bytes:
                    yield from shard(held)
                    made, held, size = made + 1, [], 0
        if held:
            yield from shard(held)

    schema = "shard long, lang string, first int, words array<string>, counts array<long>, size int, length long, codes binary"
    return docs.mapInArrow(run, schema)


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` with ids from 1 without gaps, and the largest id; only one number for each task comes to the driver."""
    words = cut_lineage(words)
    sizes = dict(words.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not total:
        return words.withColumn("id", F.lit(0).cast("long")), 0
    starts = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return words.withColumn("id", (starts[F.spark_partition_id()] + place + 1).cast("long")), total


def _shard_filters(bits: int, ranges_bits: int):
    """Cogrouped by shard: its codes, and the ids of its words; gives one filter for each range of keys."""

    def run(codes, ids):
        found = {"range": [], "filter": []}
        for stream, size, length in zip(*(codes.column(c).to_pylist() for c in ("codes", "size", "length"))):
            of_code = np.zeros(size + 1, dtype=np.uint64)
            of_code[ids.column("code").to_numpy()] = ids.column("id").to_numpy()
            held = pa.decompress(stream, decompressed_size=4 * length, codec=CODEC, asbytes=True)
            words = of_code[np.frombuffer(held, dtype="<u4")]
            left, right, counts = _ngrams(words, bits)
            if not len(left):
                continue
            left, right, counts = counted(*permute(left, right, bits), counts)
            where = (left >> np.uint64(2 * bits - ranges_bits)).astype(np.int64) if ranges_bits else np.zeros(len(left), np.int64)
            cuts = np.flatnonzero(np.diff(where)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(left)]):
                found["range"].append(int(where[start]))
                found["filter"].append(pack(left[start:end], right[start:end], counts[start:end], bits, ranges_bits))
        return pa.table({"range": pa.array(found["range"], pa.int32()), "filter": pa.array(found["filter"], pa.binary())})

    return run


def _ngrams(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed pairs and triples of neighbouring ids with their counts; 0 stands between neighbours that are none."""
    shift = np.uint64(bits)
    at = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
    pairs, which, counts = np.unique((words[at] << shift) | words[at + 1], return_inverse=True, return_counts=True)
    third = np.append(words, np.uint64(0))[at + 2]
    triples = (which.astype(np.uint64) << shift) | third
    triples, triple_counts = np.unique(triples[third > 0], return_counts=True)
    left = np.concatenate([pairs, pairs[(triples >> shift).astype(np.int64)]])
    right = np.concatenate([np.zeros(len(pairs), np.uint64), triples & np.uint64((1 << bits) - 1)])
    return left, right, np.concatenate([counts, triple_counts]).astype(np.int64)


def _merged(bits: int, least: int):
    """All filters of a range into one; gives the phrases that occur often enough."""

    def run(key, table):
        prefix, some = key[0].as_py(), (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held, size = [], 0
        for data in table.column("filter"):
            held.append(unpack(data.as_py(), prefix))
            size += len(held[-1][0])
            if size >= RANGE_ENTRIES:  # what is alike goes together before more is read
                some = counted(*(np.concatenate(x) for x in zip(some, *held)))
                held, size = [], 0
        left, right, counts = counted(*(np.concatenate(x) for x in zip(some, *held)))
        often = counts >= least
        left, right = restore(left[often], right[often], bits)
        one = np.uint64((1 << bits) - 1)
        columns = (left >> np.uint64(bits), left & one, right, counts[often])
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=["id1", "id2", "id3", "a"])

    return run


def _score(a, l, r):  # noqa: E741
    """floor(1000000 * a * a / (l * r)), in decimals of 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), wide(l) * wide(r))


def phrases(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, covered: int = 50, top: int | None = None,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases of two and three words that occur ``least`` times or more.

    A phrase of two is left out if one of three that holds it has ``covered`` percent of its occurrences or more. The
    score is that of the lowest cut. With ``top`` only the first phrases of each language are given.
    """
    docs = df.select(
        F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    )
    shards = cut_lineage(_shards(docs.where("text IS NOT NULL"), shard_bytes))
    entry = F.explode(F.arrays_zip("words", "counts", F.sequence(F.col("first") + 1, F.col("first") + F.size("words")).alias("code")))
    entries = shards.select("shard", "lang", entry.alias("e")).select("shard", "lang", "e.words", "e.counts", "e.code")
    counts = entries.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    counts = cut_lineage(counts)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words, largest = _numbered(counts.where(F.col("f") >= least))
    bits = max(largest.bit_length(), 1)
    occurrences = 2 * (words.agg(F.sum("f")).first()[0] or 0)
    ranges_bits = min(max(occurrences // RANGE_ENTRIES, df.sparkSession.sparkContext.defaultParallelism).bit_length(), 2 * bits, 30)

    ids = entries.join(words.select("lang", F.col("word").alias("words"), "id"), ["lang", "words"]).select(F.col("shard").alias("of"), "code", "id")
    codes = shards.where("codes IS NOT NULL").select("shard", "codes", "size", "length")
    filters = codes.groupBy("shard").cogroup(ids.groupBy("of")).applyInArrow(
        _shard_filters(bits, ranges_bits), "range int, filter binary"
    )
    found = filters.groupBy("range").applyInArrow(_merged(bits, least), "id1 long, id2 long, id3 long, a long")
    return _ranked(_scored(cut_lineage(found), words, covered), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _scored(found: DataFrame, words: DataFrame, covered: int) -> DataFrame:
    word = lambda k: words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"))
    first = words.select(F.col("id").alias("id1"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1"))
    pairs = cut_lineage(found.where("id3 = 0").drop("id3").join(first, "id1").join(word(2), "id2"))
    triples = found.where("id3 > 0")
    holds = triples.select("id1", "id2", F.col("a").alias("held")).union(triples.select("id2", "id3", "a"))
    holds = holds.groupBy("id1", "id2").agg(F.max("held").alias("held"))
    apart = pairs.join(holds, ["id1", "id2"], "left").where(
        F.col("held").isNull() | (100 * F.col("held") < covered * F.col("a"))
    )
    apart = apart.select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r")
    ).withColumn("score", _score("a", "l", "r"))
    head = pairs.select("id1", "id2", "lang", "w1", "w2", "f1", F.col("a").alias("head"))
    tail = pairs.select(
        F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("tail")
    )
    triples = triples.join(head, ["id1", "id2"]).join(tail, ["id2", "id3"])
    triples = triples.withColumns({"one": _score("a", "f1", "tail"), "two": _score("a", "head", "f3")})
    early = F.col("one") <= F.col("two")
    triples = triples.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(early, F.col("f1")).otherwise(F.col("head")).alias("l"),
        F.when(early, F.col("tail")).otherwise(F.col("f3")).alias("r"),
        F.least("one", "two").alias("score"),
    )
    return apart.unionByName(triples)


def _ranked(scored: DataFrame, top: int | None) -> DataFrame:
    window = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(window).cast("long"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


_PARTS = "split_part(p, ' ', 1)", "split_part(p, ' ', 2)", "split_part(p, ' ', 3)"


def phrases_sql(least: int = 10, covered: int = 50, top: int = 2000) -> str:
    """DuckDB SQL for the rows of ``phrases`` over ``documents``; words hold no spaces, so a joined phrase tells its words."""
    w1, w2, w3 = _PARTS
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang),
    grams AS (
        SELECT lang, 1 AS k, unnest(ws) AS p FROM lists
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM lists
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
        FROM lists),
    f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p),
    found AS (SELECT lang, k, p, f AS a FROM f WHERE k > 1 AND f >= {least}),
    cuts AS (
        SELECT lang, k, p, a, 1 AS cut, {w1} AS lp, CASE WHEN k = 2 THEN {w2} ELSE {w2} || ' ' || {w3} END AS rp FROM found
        UNION ALL SELECT lang, k, p, a, 2, {w1} || ' ' || {w2}, {w3} FROM found WHERE k = 3),
    scores AS (
        SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.lp JOIN f y ON y.lang = c.lang AND y.p = c.rp),
    lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
    holds AS (
        SELECT lang, p, max(a) AS held FROM (
            SELECT lang, {w1} || ' ' || {w2} AS p, a FROM found WHERE k = 3
            UNION ALL SELECT lang, {w2} || ' ' || {w3}, a FROM found WHERE k = 3) GROUP BY lang, p),
    kept AS (
        SELECT s.* FROM lowest s LEFT JOIN holds h ON h.lang = s.lang AND h.p = s.p
        WHERE s.k = 3 OR held IS NULL OR 100 * held < {covered} * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
    SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
