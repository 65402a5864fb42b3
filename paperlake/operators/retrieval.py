"""Embed texts, search vectors for a batch of queries, and build retrieval contexts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.fixed_values import NO_CONTEXT
from paperlake.functions.text import words
from paperlake.session import cut_lineage

# Vectors per shard, queries and vectors scored at once, and centroids sent to every task.
SHARD_ROWS = 50_000
QUERY_ROWS = 1024
SCORE_ROWS = 4096
MAX_CENTROIDS = 4096

_HITS = "query_id long, chunk_id long, score double"

# --- embedding ---------------------------------------------------------------

_EMBEDDERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def register_embedder(name: str, embedder: Callable[[DataFrame, str], DataFrame]) -> None:
    """``embedder(df, text_col)`` returns ``df`` with an ``embedding array<float>`` column."""
    _EMBEDDERS[name] = embedder


def hashed_words(dims: int = 64) -> Callable[[DataFrame, str], DataFrame]:
    """Unit-length hashed word counts: the same vector for the same text in every run."""

    def embed_with(df: DataFrame, text_col: str) -> DataFrame:
        counted = HashingTF(numFeatures=dims, inputCol="_words", outputCol="_counts").transform(
            df.withColumn("_words", words(F.lower(F.coalesce(F.col(text_col), F.lit("")))))
        )
        unit = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
        return unit.withColumn("embedding", vector_to_array("_unit").cast("array<float>")).drop(
            "_words", "_counts", "_unit"
        )

    return embed_with


register_embedder("hashed_words", hashed_words())


def embed(df: DataFrame, text_col: str = "text", embedder: str = "hashed_words") -> DataFrame:
    if embedder not in _EMBEDDERS:
        raise ValueError(f"unknown embedder: {embedder}")
    return _EMBEDDERS[embedder](df, text_col)


# --- exact search ------------------------------------------------------------


def _scores(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(vectors x queries) scores; rounded so that equal vectors tie whatever block they sit in."""
    if metric == "cosine":
        lengths = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        dots = vectors @ queries.T
        raw = np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)
        raw = np.maximum(raw, 0.0)
    else:
        squares = (vectors**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2 * (vectors @ queries.T)
        distance = np.sqrt(np.maximum(squares, 0.0)) if metric == "l2" else np.maximum(squares, 0.0)
        raw = 1.0 / (1.0 + distance)
    return np.round(raw, 12)


class _TopK:
    """The best k (score, id) per query over the batches of a task."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, threshold: float, metric: str):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.threshold, self.metric = threshold, metric
        self.best = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in query_ids]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for start in range(0, len(ids), SCORE_ROWS):
            self._add(ids[start : start + SCORE_ROWS], vectors[start : start + SCORE_ROWS])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = _scores(vectors, self.queries, self.metric)
        for q in range(len(self.query_ids)):
            column = scores[:, q]
            fits = column >= self.threshold
            known, known_ids = self.best[q]
            if len(known) == self.k:
                fits &= column >= known[-1]
            if not fits.any():
                continue
            all_scores = np.concatenate([known, column[fits]])
            all_ids = np.concatenate([known_ids, ids[fits]])
            order = np.lexsort((all_ids, -all_scores))[: self.k]
            self.best[q] = all_scores[order], all_ids[order]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "query_id": np.repeat(self.query_ids, [len(s) for s, _ in self.best]),
                "chunk_id": np.concatenate([i for _, i in self.best] or [np.empty(0, dtype=np.int64)]),
                "score": np.concatenate([s for s, _ in self.best] or [np.empty(0)]),
            }
        )


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=np.float64)


def _search_shards(vectors: DataFrame, queries: DataFrame, shards: int, k: int, threshold: float, metric: str) -> DataFrame:
    """The best ``k`` of every shard for every query sent to it.

    ``vectors`` holds (shard, id, embedding) and is moved once; ``queries`` holds the
    same, with a row for each shard to search. A shard's vectors come first and
    stay in memory, being few; its queries then stream past them.
    """
    rows = vectors.select("shard", F.lit(0).alias("kind"), "id", "embedding").unionByName(
        queries.select("shard", F.lit(1).alias("kind"), "id", "embedding")
    )
    together = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = None
        for batch in batches:
            starts = np.flatnonzero(np.diff(batch["shard"].to_numpy() * 2 + batch["kind"].to_numpy(), prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                part = batch.iloc[start:end]
                shard, kind = part["shard"].iloc[0], part["kind"].iloc[0]
                if shard != at:
                    at, held = shard, []
                ids, matrix = part["id"].to_numpy(dtype=np.int64), _matrix(part["embedding"])
                if kind == 0:
                    held.append((ids, matrix))
                    continue
                for first in range(0, len(ids), QUERY_ROWS):
                    top = _TopK(ids[first : first + QUERY_ROWS], matrix[first : first + QUERY_ROWS], k, threshold, metric)
                    for some, vectors_ in held:
                        top.add(some, vectors_)
                    yield top.frame()

    return together.mapInPandas(search, _HITS)


def _shards_of(vectors: DataFrame, wanted: DataFrame, shard_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(vectors with ``shard``, queries with ``shard``, number of shards) of vectors and queries that hold their ``key``.

    A key has as many shards as its size asks for, as long as its queries, which go to each of them, stay fewer than its
    vectors; a key of many queries has no more shards than keep ``SHARD_ROWS`` vectors in each.
    """
    asking = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("asking"))
    sized = vectors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(asking, "key", "left")
    fewest = F.ceil(F.col("n") / F.greatest(F.lit(SHARD_ROWS), F.lit(shard_rows)))
    paid = F.ceil(F.col("n") / F.greatest(F.coalesce("asking", F.lit(0)), F.lit(1)))
    parts = F.greatest(fewest, F.least(F.ceil(F.col("n") / shard_rows), paid)).cast("int")
    sized = cut_lineage(sized.select("key", parts.alias("parts")))
    first = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("first", F.coalesce(F.sum("parts").over(first), F.lit(0)).cast("int"))  # a row per centroid
    total = sized.agg(F.sum("parts")).first()[0] or 1
    dealt = vectors.join(F.broadcast(sized), "key").withColumn(
        "shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    )
    every = sized.select("key", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard"))
    asked = wanted.join(F.broadcast(every), "key")
    return dealt.select("shard", "id", "embedding"), asked.select("shard", "id", "embedding"), total


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def vector_search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    threshold: float = 0.0,
    metric: str = "cosine",
    where=None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The exact best ``k`` vectors per query as (query_id, rank, chunk_id, score).

    ``queries`` holds (query_id long, embedding), ``vectors`` (chunk_id long,
    embedding, ...). ``where`` filters the vectors before they are ranked
    (documents, sections, any metadata column). Cosine scores below 0 count as
    0; ``l2`` and ``sql2`` distances d score 1 / (1 + d). Vectors are dealt once to
    shards of about ``shard_rows``; queries go to every shard. A shard keeps only
    its own best k per query, so what is ranked at the end is ids and scores.
    """
    vectors, queries = _inputs(queries, vectors, metric, where)
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    hits = _search_shards(dealt, asked, shards, k, threshold, metric)
    return _ranked(hits, k).select("query_id", "rank", "chunk_id", "score")


def _inputs(queries: DataFrame, vectors: DataFrame, metric: str, where) -> tuple[DataFrame, DataFrame]:
    if metric not in ("cosine", "l2", "sql2"):
        raise ValueError(f"unknown metric: {metric}")
    if where is not None:
        vectors = vectors.where(where)
    return (
        vectors.select(F.col("chunk_id").cast("long").alias("id"), "embedding"),
        queries.select(F.col("query_id").cast("long").alias("id"), "embedding"),
    )


# --- approximate search ------------------------------------------------------


def choose_centroids(vectors: DataFrame, n: int = 64) -> DataFrame:
    """(centroid_id, embedding): ``n`` of the vectors, chosen by a hash of their id."""
    chosen = vectors.select(F.col("chunk_id").cast("long").alias("centroid_id"), "embedding")
    return chosen.orderBy(F.xxhash64("centroid_id"), "centroid_id").limit(n)


def vector_search_approx(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    threshold: float = 0.0,
    n_probe: int = 8,
    centroids: DataFrame | None = None,
    metric: str = "cosine",
    where=None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Like ``vector_search``, over the partitions of the ``n_probe`` centroids nearest to the query.

    Every vector belongs to its nearest centroid (by the same metric, ties to the
    smaller id). ``centroids`` (centroid_id long, embedding) holds at most
    ``MAX_CENTROIDS`` rows; without it ``choose_centroids`` picks some. Partitions of
    more than ``shard_rows`` are split, unless so many queries probe them that these, sent to every part, would outweigh
    the vectors; then only those of more than ``SHARD_ROWS`` are. Returned scores are exact; a neighbour in a
    partition that is not probed is missed.
    """
    rows, asked = _inputs(queries, vectors, metric, where)
    if centroids is None:
        centroids = choose_centroids(vectors)
    table = centroids.select(F.col("centroid_id").cast("long").alias("id"), "embedding").orderBy("id").limit(MAX_CENTROIDS + 1)
    table = table.toPandas()  # bounded by the limit
    if len(table) > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} centroids")
    ids, matrix = table["id"].to_numpy(dtype=np.int64), _matrix(table["embedding"])

    def probes(n: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(ids):
                    scores = _scores(matrix, _matrix(batch["embedding"]), metric).T
                    order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
                    yield batch.assign(keys=ids[order].tolist())

        return run

    schema = "id long, embedding array<double>, keys array<long>"
    as_double = F.col("embedding").cast("array<double>").alias("embedding")
    placed = rows.select("id", as_double).mapInPandas(probes(1), schema).withColumn("key", F.col("keys")[0]).drop("keys")
    wanted = asked.select("id", as_double).mapInPandas(probes(n_probe), schema)
    wanted = wanted.select("id", "embedding", F.explode("keys").alias("key"))
    dealt, sent, shards = _shards_of(placed, wanted, shard_rows)
    hits = _search_shards(dealt, sent, shards, k, threshold, metric)
    return _ranked(hits, k).select("query_id", "rank", "chunk_id", "score")


# --- hits to contexts --------------------------------------------------------


def enrich_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the document, text and section of their chunk."""
    wanted = [c for c in ("document_id", "text", "heading", "section") if c in chunks.columns]
    return hits.join(chunks.select("chunk_id", *wanted), "chunk_id", "left")


def rag_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per query (query_id, question): context, distinct sources, confidence; kept when nothing was found.

    ``hits`` are enriched and hold at most k rows per query.
    """
    entry = F.struct(
        "rank", F.concat(F.lit("["), F.col("document_id").cast("string"), F.lit("] "), F.col("text")).alias("line")
    )
    grouped = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e.line, F.lit("\n"))), "\n"
        ).alias("context"),
        F.array_sort(F.collect_set("document_id")).alias("sources"),
        F.avg("score").alias("confidence"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    found = queries.join(grouped, "query_id", "left")
    none = F.col("n_chunks").isNull()
    return found.select(
        "query_id",
        "question",
        F.when(none, NO_CONTEXT).otherwise(F.col("context")).alias("context"),
        F.coalesce("sources", F.array().cast(found.schema["sources"].dataType)).alias("sources"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
    )


def _first_chunks(chunks: DataFrame, n: int | None) -> DataFrame:
    """The non-empty chunks of each document; the first ``n`` of them if given."""
    filled = chunks.where(F.coalesce("text", F.lit("")) != "")
    if n is None:
        return filled
    window = Window.partitionBy("document_id").orderBy("chunk_index")
    return filled.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def _joined_text(chunks: DataFrame, separator: str, name: str) -> DataFrame:
    texts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(texts, lambda t: t.text), separator).alias(name))


def summary_context(chunks: DataFrame) -> DataFrame:
    """All chunk texts of a document in order, a blank line between them."""
    return _joined_text(chunks, "\n\n", "context")


def similar_context(
    chunks: DataFrame, similar_chunks: DataFrame, n_chunks: int | None = None, chars: int | None = None
) -> DataFrame:
    """Text of a document's chunks, with each similar chunk.

    ``similar_chunks`` holds (document_id, rank, text) with at most k rows per
    document. ``n_chunks`` keeps the first chunks of the document, ``chars`` the
    first characters of each similar chunk.
    """
    source = _joined_text(_first_chunks(chunks, n_chunks), "\n", "source_text")
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    near = similar_chunks.groupBy("document_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))),
                lambda t: F.concat(F.lit("- "), t.text),
            ),
            "\n",
        ).alias("related")
    )
    return source.join(near, "document_id", "left").withColumn("related", F.coalesce("related", F.lit("")))


def document_queries(chunks: DataFrame, ids: DataFrame, n: int | None = None) -> DataFrame:
    """A query vector per document of ``ids``: the mean of its chunk vectors, of the first ``n`` if given."""
    wanted = chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    first = wanted
    if n is not None:
        window = Window.partitionBy("document_id").orderBy("chunk_index")
        first = wanted.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n)
    means = (
        first.select("document_id", F.posexplode("embedding").alias("i", "x"))
        .groupBy("document_id", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("document_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e.x).alias("embedding"))
    )
    return means.select(F.col("document_id").cast("long").alias("query_id"), "embedding")


def similar_documents(
    chunks: DataFrame, ids: DataFrame, k: int = 10, include_self: bool = True, n: int | None = None
) -> DataFrame:
    """Distinct documents among the ``k`` nearest chunks of each given document, best score first.

    ``n`` takes the first chunks of a document only for its query vector.

    ``chunks`` holds (chunk_id long, document_id, chunk_index, embedding).
    """
    hits = vector_search(document_queries(chunks, ids, n), chunks, k)
    found = enrich_hits(hits, chunks)
    if not include_self:
        found = found.where(F.col("query_id") != F.col("document_id"))
    return (
        found.groupBy("query_id", "document_id")
        .agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"))
        .withColumnRenamed("document_id", "similar_document_id")
    )


def hybrid_search(hits: DataFrame, lexical: DataFrame, weight: float = 0.5, k: int = 10) -> DataFrame:
    """Weighted sum, to nine digits, of vector and lexical scores, both (query_id, chunk_id, score); an extension.

    ``lexical.lexical_search`` and ``lexical.normalised`` give lexical scores.
    """
    scored = (
        hits.select("query_id", "chunk_id", F.col("score").alias("vector_score"))
        .join(lexical.select("query_id", "chunk_id", F.col("score").alias("lexical_score")), ["query_id", "chunk_id"], "full")
        .withColumn(
            "score",
            F.round(F.coalesce("vector_score", F.lit(0.0)) * weight + F.coalesce("lexical_score", F.lit(0.0)) * (1 - weight), 9),
        )
    )
    return _ranked(scored, k).select("query_id", "rank", "chunk_id", "score")
