"""Lexical search: an inverted index in blocks, BM25 scores, and the best chunks without reading most blocks.

The index is a table with a row for each term and block of chunks: what each chunk's score gains by the term (its
impact) and the largest of these. Chunks of like length share a block, as short ones gain most; a frequent term has
many blocks, so no row and no key grows with the table. A search adds up the largest impacts of the terms of a query
for each block, which bounds every score in it, scores the most promising blocks, and then only those others whose
bound reaches the k-th best score found. The result is the same as scoring everything. The words of few queries are
sent to the blocks: a task walks past its blocks and keeps the best k of each query, so neither postings nor scores
move. Only with very many queries are postings, bounds and scores joined.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.rows import explode_once
from paperlake.operators.retrieval import _ranked
from paperlake.session import cut_lineage, is_small

K1, B = 1.2, 0.75
BLOCK_ROWS = 128  # chunks of a block, about
NOT_A_WORD = r"[^\p{L}\p{N}]+"


@dataclass
class LexicalIndex:
    postings: DataFrame  # (term, block, top, entries: array of (chunk_id, impact))
    terms: DataFrame  # (term, df, idf)
    together: bool = False  # whether the rows of a block follow each other in one partition


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


_COUNTED = "block string, chunk_id long, length int, terms string, tfs binary"
_PACKED = "block string, terms string, sizes binary, places binary, codes binary, ids binary, impacts binary"
_POSTINGS = "term string, block string, top double, entries array<struct<chunk_id: long, impact: double>>"


def _pack(numbers: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(numbers.max(initial=0))).newbyteorder("<").str
    return kind.encode() + zlib.compress(numbers.astype(kind).tobytes(), 1)


def _unpack(held: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(held[3:]), held[:3].decode()).astype(np.int64)


def _strings(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _counted(batches):
    """The distinct words of each row, joined by blanks, and how often each stands in it; words hold no blanks."""
    for batch in batches:
        lists = batch.column("words")
        flat = pc.dictionary_encode(lists.flatten())
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        held = max(len(flat.dictionary), 1)
        cells, tfs = np.unique(row * held + flat.indices.to_numpy(), return_counts=True)
        cuts = np.searchsorted(cells, np.arange(len(lists) + 1) * held)
        words = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat.dictionary.take(pa.array(cells % held)))
        bytes_ = pa.py_buffer(tfs.astype("<u4").tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "block": batch.column("block"),
                "chunk_id": batch.column("chunk_id"),
                "length": batch.column("length"),
                "terms": pc.binary_join(words, " "),
                "tfs": pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((4 * cuts).astype("<i4").tobytes()), bytes_]),
            }
        )


def _each_block(batches):
    """(block, table) of rows that are together; a block may run over several batches."""
    at, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = pc.run_end_encode(batch.column("block"))
        start = 0
        for name, end in zip(names.values.to_pylist(), names.run_ends.to_pylist()):
            if name != at and parts:
                yield at, pa.Table.from_batches(parts).combine_chunks()
                parts = []
            at = name
            parts.append(batch.slice(start, end - start))
            start = end
    if parts:
        yield at, pa.Table.from_batches(parts).combine_chunks()


def _packed(k1: float, b: float, mean: float):
    """The postings of each block in one row: places of chunks and codes of impacts in small numbers."""

    def run(batches):
        for block, rows in _each_block(batches):
            lists = pc.split_pattern(_strings(rows.column("terms")), " ")
            flat = pc.dictionary_encode(lists.flatten())
            order = pc.sort_indices(flat.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            term = rank[flat.indices.to_numpy()]
            tfs = np.frombuffer(b"".join(rows.column("tfs").to_pylist()), "<u4")
            # rows of one chunk and length count together
            chunks, own = np.unique(
                np.stack([rows.column("chunk_id").to_numpy(), rows.column("length").to_numpy()]), axis=1, return_inverse=True
            )
            place = np.repeat(own.reshape(-1), pc.list_value_length(lists).to_numpy())
            cells, back = np.unique(term * chunks.shape[1] + place, return_inverse=True)
            tf = np.bincount(back.reshape(-1), tfs)
            term, place = np.divmod(cells, chunks.shape[1])
            impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * chunks[1][place] / mean))
            impacts, codes = np.unique(impact, return_inverse=True)
            yield pa.RecordBatch.from_pylist([{
                "block": block, "terms": " ".join(flat.dictionary.take(pa.array(order)).to_pylist()),
                "sizes": _pack(np.bincount(term)), "places": _pack(place), "codes": _pack(codes.reshape(-1)),
                "ids": chunks[0].astype("<i8").tobytes(), "impacts": impacts.astype("<f8").tobytes(),
            }], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([(n, pa.string() if kind == "string" else pa.binary()) for n, kind in (x.split() for x in _PACKED.split(", "))])


def _held(batches):
    """(term, df) of each block."""
    for batch in batches:
        for terms, sizes in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(terms.split(" ")), pa.array(_unpack(sizes))], ["term", "df"])


def _unfolded(batches):
    """Packed blocks as postings."""
    for batch in batches:
        for row in range(batch.num_rows):
            at = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
            terms = at["terms"].split(" ")
            starts = np.concatenate([[0], np.cumsum(_unpack(at["sizes"]))])
            ids = np.frombuffer(at["ids"], "<i8")[_unpack(at["places"])]
            impacts = np.frombuffer(at["impacts"], "<f8")[_unpack(at["codes"])]
            entries = pa.StructArray.from_arrays([pa.array(ids), pa.array(impacts)], ["chunk_id", "impact"])
            yield pa.RecordBatch.from_pydict(
                {
                    "term": pa.array(terms),
                    "block": pa.array([at["block"]] * len(terms)),
                    "top": pa.array(np.maximum.reduceat(impacts, starts[:-1])),
                    "entries": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), entries),
                }
            )


def build_index(chunks: DataFrame, text_col: str = "text", k1: float = K1, b: float = B, block_rows: int = BLOCK_ROWS) -> LexicalIndex:
    """The index of ``chunks`` (chunk_id long, text); ids are unique, chunks without words are not held.

    Both tables can be written and read again. Impacts count against the mean length of these chunks, so a table that
    has grown much is indexed anew.
    """
    words = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), tokens(F.col(text_col)).alias("words"))
    words = words.where("chunk_id IS NOT NULL").withColumn("length", F.size("words")).where("length > 0")
    # chunks of like length: four classes for each doubling, so there are few classes however many chunks there are
    like = F.floor(F.log2("length") * 4).cast("int")
    found = words.groupBy(like.alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).collect()
    n, total = sum(c["n"] for c in found), sum(c["total"] for c in found)
    classes = chunks.sparkSession.createDataFrame([(c["class"], -(-c["n"] // block_rows)) for c in found], "class int, parts long")
    placed = words.withColumn("class", like).join(F.broadcast(classes), "class")
    block = F.concat_ws("/", "class", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))
    # words are counted in their row, and the chunks of a block move once, as their distinct terms and numbers of them
    sent = placed.select("chunk_id", "length", block.alias("block"), "words").mapInArrow(_counted, _COUNTED)
    together = sent.repartition("block").sortWithinPartitions("block", "chunk_id")
    blocks = cut_lineage(together.mapInArrow(_packed(k1, b, total / n if n else 1.0), _PACKED))
    frequency = blocks.select("terms", "sizes").mapInArrow(_held, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return LexicalIndex(blocks.mapInArrow(_unfolded, _POSTINGS), frequency.select("term", "df", idf.alias("idf")), together=True)


def lexical_search(queries: DataFrame, index: LexicalIndex, k: int = 10, text_col: str = "question") -> DataFrame:
    """The ``k`` best chunks of each query (query_id long, question) by BM25 as (query_id, rank, chunk_id, score).

    Ties go to the smaller id; a word counts once in a query; queries without a known word find nothing.
    """
    words = F.array_distinct(tokens(F.col(text_col)))
    asked = explode_once(queries.select(F.col("query_id").cast("long").alias("query_id"), text_col), words, "term")
    asked = cut_lineage(asked.drop(text_col).distinct().join(index.terms.select("term", "idf"), "term"))
    terms = asked.select("term").distinct()
    if is_small(terms):  # then only what the queries ask for is read, and the index stays where it is
        index = LexicalIndex(index.postings.join(F.broadcast(terms), "term", "left_semi"), index.terms, index.together)
    if is_small(asked):
        return _ranked(_best_of_blocks(asked, index, k), k).select("query_id", "rank", "chunk_id", "score")
    bounds = block_bounds(asked, index)
    scored, rest = _first_blocks(asked, index, bounds, k)
    scored = scored.unionByName(_scores(asked, index, rest))
    return _ranked(scored, k).select("query_id", "rank", "chunk_id", "score")


def _best_of_blocks(asked: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the ``k`` best of each query among the blocks of each task; ``asked`` is sent to all tasks."""
    words = asked.select("query_id", "term", "idf").toArrow().sort_by([("term", "ascending"), ("query_id", "ascending")])
    queries, query = np.unique(words.column("query_id").to_numpy(), return_inverse=True)
    vocabulary = _strings(pc.unique(words.column("term")))
    sizes = pc.value_counts(_strings(words.column("term"))).field("counts").to_numpy()
    starts, idf = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), words.column("idf").to_numpy()
    postings = index.postings if index.together else index.postings.repartition("block").sortWithinPartitions("block")

    def run(batches):
        best = _Best(len(queries), k)
        for _, rows in _each_block(batches):
            known = pc.fill_null(pc.index_in(_strings(rows.column("term")), value_set=vocabulary), -1).to_numpy()
            asking = np.flatnonzero(known >= 0)  # rows of words that are asked for
            known = known[asking]
            row, place = _spans(asking, starts[known], sizes[known])
            gain, who = idf[place], query[place]
            bound = np.bincount(who, gain * rows.column("top").to_numpy()[row], len(queries))
            live = (bound > 0) & (bound * (1 + 1e-9) >= best.least)  # sums may differ in their last digits
            if not live.any():
                continue
            kept = live[who]
            row, gain, who = row[kept], gain[kept], (np.cumsum(live) - 1)[who[kept]]
            entries = _strings(rows.column("entries"))
            offsets, held = entries.offsets.to_numpy().astype(np.int64) - entries.offsets[0].as_py(), entries.flatten()
            ids, own = np.unique(held.field("chunk_id").to_numpy(), return_inverse=True)
            pair, entry = _spans(np.arange(len(row)), offsets[row], (offsets[1:] - offsets[:-1])[row])
            gained = gain[pair] * held.field("impact").to_numpy()[entry]
            scores = np.bincount(who[pair] * len(ids) + own.reshape(-1)[entry], gained, int(live.sum()) * len(ids))
            best.add(np.flatnonzero(live), ids, scores.reshape(-1, len(ids)))
        best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(queries[best.query]), pa.array(best.ids), pa.array(best.scores)], ["query_id", "chunk_id", "score"])

    return postings.select("block", "term", "top", "entries").mapInArrow(run, "query_id long, chunk_id long, score double")


def _spans(owner: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all places of the spans."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(owner, sizes), np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


class _Best:
    """The best k (score, id) of each query among those added."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.parts, self.waiting = [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        held = scores > 0
        scores = np.round(scores, 12)
        row, col = np.nonzero(held & (scores >= self.least[query][:, None]))
        self.parts.append((query[row], ids[col], scores[row, col]))
        self.waiting += len(row)
        if self.waiting > max(1 << 14, 2 * len(self.ids)):
            self.cut()

    def cut(self) -> None:
        query, ids, scores = (np.concatenate(x) for x in zip((self.query, self.ids, self.scores), *self.parts))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.ids, self.scores = query[kept], ids[kept], scores[kept]
        last = place == self.k - 1
        self.least[query[last]] = scores[last]
        self.parts, self.waiting = [], 0


def block_bounds(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, block, bound, held): no chunk of the block scores more; it holds at least so many with a word of the query."""
    tops = index.postings.select("term", "block", "top", F.size("entries").alias("held"))
    return (
        asked.join(tops, "term").groupBy("query_id", "block")
        .agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.max("held").alias("held"))
    )


def _first_blocks(asked: DataFrame, index: LexicalIndex, bounds: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(the k best of the most promising blocks, the other blocks that may yet hold a better chunk) of each query."""
    bounds = cut_lineage(bounds)
    # the most promising blocks that surely hold k chunks; a block holds one at least, so k blocks are enough
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    before = F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).where(F.col("before") < k).select("query_id", "block")
    scored = cut_lineage(_ranked(_scores(asked, index, first), k).select("query_id", "chunk_id", "score", "rank"))
    enough = scored.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(enough, "query_id", "left")
    # sums may differ in their last digits
    rest = rest.where(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) >= F.col("least"))).select("query_id", "block")
    return scored.drop("rank"), rest


def _scores(asked: DataFrame, index: LexicalIndex, blocks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks in the given (query_id, block) that hold a word of the query."""
    wanted = asked.join(blocks, "query_id")
    met = wanted.join(index.postings.select("term", "block", "entries"), ["term", "block"])
    each = explode_once(met.select("query_id", "idf", "entries"), F.col("entries"), "entry")
    gained = each.select("query_id", F.col("entry.chunk_id").alias("chunk_id"), (F.col("idf") * F.col("entry.impact")).alias("g"))
    return gained.groupBy("query_id", "chunk_id").agg(F.round(F.sum("g"), 12).alias("score"))


def normalised(hits: DataFrame) -> DataFrame:
    """Scores as shares of the best one of each query, so that they can be added to cosines."""
    best = F.max("score").over(Window.partitionBy("query_id"))  # k rows of a query
    return hits.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(0.0))
