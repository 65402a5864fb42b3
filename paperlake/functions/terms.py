"""Rows of texts met with the rows of terms that occur in them, for many terms over many texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.functions import automaton
from paperlake.functions.rows import explode_once
from paperlake.session import is_small

BLOCK_BYTES = 64 << 20  # of texts that meet one shard of terms in a task

_built: dict[int, tuple[pa.Array, automaton.Automaton]] = {}  # of a worker: the terms it was given last


def _cells(terms: DataFrame) -> int:
    """The size of the table of next states that all terms need together; each task reports bytes and a mask of them."""

    def run(batches):
        size, mask = 0, np.zeros(256, dtype=bool)
        for batch in batches:
            data, _ = automaton._spans(batch.column(0))
            size += len(data)
            mask[data] = True
        yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int64()), "mask": pa.array([mask.tobytes()], pa.binary())})

    found = terms.mapInArrow(run, "size long, mask binary").collect()  # one row for each task
    size = sum(r.size for r in found)
    return (size + 1) * (sum(any(column) for column in zip(*(r["mask"] for r in found))) + 1)


def match_terms(
    texts: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term", max_cells: int = automaton.MAX_CELLS
) -> DataFrame:
    """Every row of ``texts`` with every row of ``terms`` whose term occurs in its text, case ignored.

    An automaton of all terms reads each text once. Terms whose automaton has at most ``max_cells`` cells are broadcast,
    and texts stay where they are; more terms are dealt to shards of that size, and each text is sent once to each shard.
    Only hits are emitted. Both frames keep their columns, which must have different names; null and empty terms and
    null texts match nothing.
    """
    lowered = terms.withColumn("_term", F.lower(term_col)).where("_term <> ''")
    distinct = lowered.select("_term").distinct()
    cells = _cells(distinct)
    if cells <= max_cells:
        return _with_broadcast(texts, lowered, distinct, text_col)
    return _with_shards(texts, lowered, distinct, text_col, -(-cells * 5 // (max_cells * 4)))


def _with_broadcast(texts: DataFrame, lowered: DataFrame, distinct: DataFrame, text_col: str) -> DataFrame:
    spark: SparkSession = texts.sparkSession
    held = distinct.toArrow().column("_term").combine_chunks()  # bounded by the size of the automaton
    shared = spark.sparkContext.broadcast(held)

    def find(column: pa.Array) -> pa.Array:
        return automaton.hits(_automaton(shared), column)

    found = F.arrow_udf(find, "array<int>")
    hit = explode_once(texts, found(F.lower(F.coalesce(F.col(text_col), F.lit("")))), "_number")
    numbers = pa.table({"_number": pa.array(range(len(held)), pa.int32()), "_term": held})
    numbered = lowered.join(F.broadcast(spark.createDataFrame(numbers, "_number int, _term string")), "_term").drop("_term")
    return hit.join(F.broadcast(numbered) if is_small(lowered) else numbered, "_number").drop("_number")


def _automaton(shared) -> automaton.Automaton:
    """The automaton of broadcast terms, built once in each worker."""
    key = id(shared.value)
    if key not in _built:
        _built.clear()
        _built[key] = (shared.value, automaton.build(shared.value))
    return _built[key][1]


def _with_shards(texts: DataFrame, lowered: DataFrame, distinct: DataFrame, text_col: str, shards: int) -> DataFrame:
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = texts.withColumns({"_text": text, "_block": F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")})
    dealt = dealt.where("_text <> ''").withColumn("_shard", every(shards))
    sent = distinct.select("_term", F.pmod(F.xxhash64("_term"), F.lit(shards)).cast("int").alias("_at"))
    sent = sent.select("_term", "_at", every(blocks).alias("_of"))
    out = T.StructType([*texts.schema.fields, T.StructField("_term", T.StringType())])

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(out, [*(left.schema.field(c).type for c in texts_columns), pa.string()])})
        terms = right.column("_term").combine_chunks()
        lists = automaton.hits(automaton.build(terms), left.column("_text").combine_chunks())
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        return left.select(texts_columns).take(pa.array(rows)).append_column("_term", terms.take(lists.values))

    texts_columns = texts.columns
    found = dealt.groupBy("_shard", "_block").cogroup(sent.groupBy("_at", "_of")).applyInArrow(run, out)
    return found.join(lowered, "_term").drop("_term")
