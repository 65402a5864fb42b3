"""Token counts of whole texts under a SentencePiece model (operator 8).

A text is cut into pre-tokens that no piece crosses, so its count is the sum of
their counts. Tier one is a broadcast open-addressing table of the hashes of
frequent pre-tokens and their lengths, looked up for all pre-tokens of a chunk
at once. They are found in a scan of all rows: each task keeps a summary of
bounded size (after Misra and Gries), and the summaries are added up. Tier two is a dictionary in each Python worker; what it lacks goes
to the sentencepiece library in one batch. No pre-token is ever shuffled.

Pre-tokens are told apart by 64-bit hashes. Defined results: a null or empty
text has 0 bytes and 0 tokens; texts are counted whole; repeated rows count
alike; an empty table gives no rows; input columns named like an added one are
replaced, all others stay.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.sentencepiece_model import MARK, parse_model, plain_processor, shipped, splits_at_marks
from paperlake.llm.textbytes import chunks, span_hashes

TABLE_BITS = 17  # 131,072 slots, filled by half at most: the broadcast is about 1.2 MB
SUMMARY = 1 << 15  # pre-tokens a task reports; all that are as frequent as one in so many are among them
LONGEST = 64  # bytes of a pre-token of the table
CACHED = 400_000  # pre-tokens a worker remembers


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of pre-tokens: spaces with what follows them, or a line feed alone."""
    space, feed = data == 32, data == 10
    start = np.zeros(len(data), dtype=bool)
    if len(data):
        start[1:] = (space[1:] & ~space[:-1]) | (feed[:-1] & ~space[1:])
        start |= feed
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(data)) if len(starts) else starts


def fill_table(hashes: np.ndarray, lengths: np.ndarray, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing; length 0 marks a free slot."""
    keys, values = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.uint8)
    mask = (1 << bits) - 1
    for key, length in zip(hashes.tolist(), lengths.tolist()):
        slot = key & mask
        while values[slot]:
            slot = (slot + 1) & mask
        keys[slot], values[slot] = key, length
    return keys, values


def look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The length of each hash, 0 where the table lacks it."""
    keys, values = table
    mask = np.uint64(len(keys) - 1)
    slots = hashes & mask
    found = np.where(keys[slots] == hashes, values[slots], 0).astype(np.int64)
    open_ = np.flatnonzero((found == 0) & (values[slots] != 0))
    while len(open_):
        slots[open_] = (slots[open_] + np.uint64(1)) & mask
        hit = (keys[slots[open_]] == hashes[open_]) & (values[slots[open_]] != 0)
        found[open_[hit]] = values[slots[open_[hit]]]
        open_ = open_[~hit & (values[slots[open_]] != 0)]
    return found


@lru_cache(maxsize=1)
def _processor(path: str):
    with open(path, "rb") as file:
        return plain_processor(file.read())


_worker_cache: dict[int, int] = {}


def _lengths(processor, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    text = data.tobytes()
    found = processor.encode([text[a:b].decode() for a, b in zip(starts, ends)], num_threads=1)
    return [len(ids) for ids in found]


def _prefixed(texts: pa.Array) -> pa.Array:
    """Each non-empty text with the mark that the library puts before it, marks as spaces."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pc.replace_substring(texts, MARK, " ")
    marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, marked)


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])]
    )


def _summed(parts: list[pa.Table], most: int) -> pa.Table:
    """Distinct pre-tokens of ``parts`` with their counts; of more than ``4 * most`` those above the ``most``-th, less its count."""
    found = pa.concat_tables(parts).group_by("hash", use_threads=False).aggregate([("n", "sum"), ("text", "min")])
    found = found.select(["hash", "n_sum", "text_min"]).rename_columns(["hash", "n", "text"])
    if found.num_rows > 4 * most:
        n = found.column("n").to_numpy()
        less = n - np.partition(n, -most)[-most]
        found = found.set_column(1, "n", pa.array(less)).filter(pa.array(less > 0))
    return found


def _summaries(df: DataFrame, text_col: str, most: int) -> DataFrame:
    """(hash, n, text) of the frequent pre-tokens of each task."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(_prefixed(batch.column(text_col))):
                starts, ends = pretokens(data, offsets)
                short = ends - starts <= LONGEST
                starts, ends = starts[short], ends[short]
                hashes, first, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
                columns = {"hash": pa.array(hashes.view(np.int64)), "n": pa.array(n.astype(np.int64))}
                held.append(pa.table({**columns, "text": _spans(data, starts[first], ends[first])}))
                size += len(hashes)
                if size > 16 * most:
                    held = [_summed(held, most)]
                    size = held[0].num_rows
        if held:
            found = _summed(held, most).sort_by([("n", "descending"), ("hash", "ascending")]).slice(0, most)
            yield from found.set_column(2, "text", found.column("text").cast(pa.binary())).combine_chunks().to_batches()

    return df.select(text_col).mapInArrow(run, "hash long, n long, text binary")


def _frequent(df: DataFrame, path: str, text_col: str, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The table, filled by half with the commonest pre-tokens of all texts."""
    processor = _processor(path)
    found = _summaries(df, text_col, most).groupBy("hash").agg(F.sum("n").alias("n"), F.min("text").alias("text"))
    top = found.orderBy(F.desc("n"), "hash").limit(1 << (bits - 1)).collect()  # bounded by the table
    lengths = np.array([len(ids) for ids in processor.encode([bytes(r.text).decode() for r in top], num_threads=1)], dtype=np.int64)
    hashes = np.array([r.hash for r in top], dtype=np.int64).view(np.uint64)
    fits = (lengths > 0) & (lengths < 256)
    return fill_table(hashes[fits], lengths[fits], bits)


def count_tokens(
    df: DataFrame,
    model_path: str,
    text_col: str = "text",
    limit: int = 4096,
    table_bits: int = TABLE_BITS,
    summary: int = SUMMARY,
) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each whole text."""
    with open(model_path, "rb") as file:
        model = parse_model(file.read())
    if not splits_at_marks(model) or model.charsmap or model.remove_extra_whitespaces or not model.add_dummy_prefix:
        raise ValueError("counts of pre-tokens do not add up under this model")
    name = shipped(df, model_path)
    table = df.sparkSession.sparkContext.broadcast(_frequent(df, model_path, text_col, table_bits, summary))
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    kept = [f for f in df.schema.fields if f.name not in added and f.name != text_col]
    out = T.StructType([*kept, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches):
        processor = _processor(SparkFiles.get(name))
        for batch in batches:
            texts = batch.column(text_col)
            n_tokens = np.zeros(batch.num_rows, dtype=np.int64)
            for row, rows, data, offsets in chunks(_prefixed(texts)):
                starts, ends = pretokens(data, offsets)
                if not len(starts):
                    continue
                hashes = span_hashes(data, starts, ends)
                lengths = look_up(table.value, hashes)
                rest = np.flatnonzero(lengths == 0)
                if len(rest):
                    distinct, first, back = np.unique(hashes[rest], return_index=True, return_inverse=True)
                    known = [_worker_cache.get(h) for h in distinct.tolist()]
                    new = [k for k, n in enumerate(known) if n is None]
                    if len(_worker_cache) + len(new) > CACHED:
                        _worker_cache.clear()
                    at = rest[first[new]]
                    for k, n in zip(new, _lengths(processor, data, starts[at], ends[at])):
                        known[k] = n
                        _worker_cache[int(distinct[k])] = n
                    lengths[rest] = np.array(known, dtype=np.int64)[back]
                total = np.concatenate([[0], np.cumsum(lengths)])
                n_tokens[row : row + rows] = np.diff(total[np.searchsorted(starts, offsets)])
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counted = {"n_bytes": n_bytes, "n_tokens": pa.array(n_tokens), "over_limit": pa.array(n_tokens > limit)}
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *counted.values()], out.names)

    return df.mapInArrow(run, out)
