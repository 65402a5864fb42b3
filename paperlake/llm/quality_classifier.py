"""Quality of texts by logistic regression over hashed word n-grams (operator 12).

Features of a text are the buckets of its words and of its pairs of neighbouring words, weighted 1 + log(count) and
scaled to length 1. A word is a longest run of letters, digits and characters beyond ASCII, or of other visible
characters; case is ignored in ASCII, and a word that repeats the one before counts as the token "again".

Weights are learned by follow-the-regularised-leader updates, one text at a time, in an order fixed by hashes, over a
sample of labelled rows that is bounded by ``SAMPLE_ROWS``; it is drawn by a hash of the id from all labelled rows.
Features are made in parallel; one task then streams past them, so it holds the weights and a batch. Scores of all
rows are sparse dot products with the broadcast weights (``BUCKETS`` numbers).

Defined results: null and empty texts score by the constant term alone; labels that are null or neither 0 nor 1, ids
that are null and ids with both labels teach nothing; of labelled rows of one id one text teaches (the one whose
features come first in byte order); without labelled rows every score is 0.5; columns of the input named like a new
one are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.textbytes import chunks, lower_bytes, mix, span_hashes
from paperlake.session import cut_lineage

BUCKETS = 1 << 18
SAMPLE_ROWS = 20_000  # labelled rows that teach, at most
EPOCHS = 3

_KIND = np.full(256, 2, dtype=np.uint8)  # 0 white space and controls, 1 word characters, 2 others
_KIND[:33] = 0
_KIND[127] = 0
_KIND[128:] = 1
for _first, _last in ("09", "AZ", "az"):
    _KIND[ord(_first) : ord(_last) + 1] = 1
_AGAIN = mix(np.array([12], dtype=np.uint64))[0]
_PAIR = mix(np.array([21], dtype=np.uint64))[0] | np.uint64(1)


@dataclass
class QualityModel:
    weights: np.ndarray  # of each bucket
    constant: float

    def scores(self, rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        sums = np.bincount(rows, weights=self.weights[buckets] * values, minlength=n) + self.constant
        return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the hashed n-grams of each text, ordered by row and bucket."""
    kind = _KIND[data]
    new = np.ones(len(data), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    hashes = span_hashes(lower_bytes(data), starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    together = row[1:] == row[:-1]
    again = np.concatenate([[False], together & (hashes[1:] == hashes[:-1])])
    hashes = np.where(again, _AGAIN, hashes)
    pairs = mix(hashes[:-1] * _PAIR + hashes[1:])[together]
    keys = np.concatenate([hashes, pairs]) & np.uint64(BUCKETS - 1)
    keys |= np.concatenate([row, row[1:][together]]).astype(np.uint64) << np.uint64(18)
    keys, counts = np.unique(keys, return_counts=True)
    row, bucket = (keys >> np.uint64(18)).astype(np.int64), (keys & np.uint64(BUCKETS - 1)).astype(np.int64)
    values = 1 + np.log(counts)
    return row, bucket, values / np.sqrt(np.bincount(row, weights=values * values))[row]


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """(id, label, place) of at most ``rows`` labelled ids, the first by hash."""
    clean = labelled.where("id IS NOT NULL AND label IN (0, 1)")
    clean = clean.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    return clean.select("id", "label", F.xxhash64("id").alias("place")).orderBy("place", "id").limit(rows)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start, n, data, offsets in chunks(batch.column("text")):
                row, bucket, value = features(data, offsets)
                cuts = np.searchsorted(row, np.arange(n + 1))
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                part = batch.slice(start, n)
                columns = [part.column(c) for c in ("id", "label", "place")]
                columns += [cut(bucket.astype("<u4")), cut(value.astype("<f4"))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "place", "buckets", "values"])

    return docs.mapInArrow(run, "id long, label int, place long, buckets binary, values binary")


def train(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, rate: float = 1.0, l1: float = 1e-4, l2: float = 1e-3,
) -> QualityModel:
    """A model of the 0/1 labels given by id; ``sample_rows`` bounds what it is fitted on, ``df`` may be of any size."""
    spark = df.sparkSession
    labelled = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    sample = cut_lineage(_sample(labelled, sample_rows))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = _featured(docs.join(F.broadcast(sample), "id"))  # at most sample_rows rows are broadcast
    found = found.groupBy("id").agg(F.min(F.struct("buckets", "values", "label", "place")).alias("row")).select("id", "row.*")
    ordered = cut_lineage(found.repartition(1).sortWithinPartitions("place", "id"))
    state = np.zeros((2, BUCKETS + 1))
    for _ in range(epochs):
        state = _passed(ordered, spark.sparkContext.broadcast(state), rate, l1, l2)
    weights = _weights(state, rate, l1, l2)
    return QualityModel(weights[:-1], float(weights[-1]))


def _weights(state: np.ndarray, rate: float, l1: float, l2: float) -> np.ndarray:
    z, n = state
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((1 + np.sqrt(n)) / rate + l2))


def _passed(ordered: DataFrame, state, rate: float, l1: float, l2: float) -> np.ndarray:
    """The state (gradients less what the weights account for, squared gradients) after one more pass; the last place is the constant."""

    def run(batches):
        z, n = state.value.copy()
        for batch in batches:
            for label, buckets, values in zip(*(batch.column(c).to_pylist() for c in ("label", "buckets", "values"))):
                at = np.append(np.frombuffer(buckets, "<u4"), BUCKETS)
                x = np.append(np.frombuffer(values, "<f4").astype(np.float64), 1.0)
                w = _weights(np.stack([z[at], n[at]]), rate, l1, l2)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate
                z[at] += g - step * w
                n[at] += g * g
        yield pa.RecordBatch.from_pydict({"state": pa.array([np.stack([z, n]).tobytes()], pa.binary())})

    rows = ordered.select("label", "buckets", "values").mapInArrow(run, "state binary").collect()  # one row, as one task
    return np.frombuffer(rows[0].state).reshape(2, -1) if rows else state.value


def predict(df: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from 0.5 on)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name not in ("score", "predicted")]
    out = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for start, n, data, offsets in chunks(batch.column(text_col)):
                score = shared.value.scores(*features(data, offsets), n)
                part = batch.slice(start, n)
                columns = [*(part.column(f.name) for f in kept), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return df.mapInArrow(run, out)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1
