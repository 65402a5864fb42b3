"""Nearest neighbours by vantage-point trees, one per shard of the vectors (operator 6).

A vantage point splits its node's vectors at their median distance from it. A
query skips the far half when the triangle inequality rules it out: when the
query is further from the border than its k-th nearest distance so far, times
``relax``. With ``relax`` = 1 the search is exact; smaller values prune more
and may miss neighbours. Distances returned are exact in any case.

Vectors are dealt once to shards of bounded size, each with one tree; queries
stream past the trees in blocks of bounded size, and the best k of each query
and shard are then merged by rank. Where there are fewer shards than tasks, a shard
has some copies that share its queries. No side is broadcast or collected, however
large.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, neither as queries nor as candidates; nor do those of
a length other than the most frequent one, or with a null id. A query is never its own neighbour (by id). Ties go to
the smaller id, equal vectors are all candidates, of a repeated id the first vector in order of its entries takes
part; with fewer candidates than k all are returned; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.session import cut_lineage

SHARD_ROWS = 20_000
QUERY_ROWS = 4_000
LEAF = 128
SLACK = 1e-9  # of a distance: rounding must never prune a tie


def distances(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed dimension by dimension in double precision."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        step = vectors[:, k] - point[..., k]
        total += step * step
    return np.sqrt(total)


def near_distances(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The same but for rounding, faster; for the borders of nodes, which ``SLACK`` guards."""
    step = vectors - point
    return np.sqrt(np.einsum("ij,ij->i", step, step))


class Tree:
    """Nodes hold a vantage point, its median distance, and two halves; leaves hold up to ``LEAF`` vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7):
        self.ids, self.vectors, self.squares = ids, vectors, np.einsum("ij,ij->i", vectors, vectors)
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = rows[self.random.integers(len(rows))]
        away = near_distances(self.vectors[rows], self.vectors[vantage])
        border = float(np.median(away))
        inside = away <= border
        if inside.all():  # more than half of the vectors at one distance: no border tells them apart
            return rows
        return vantage, border, self._build(rows[inside]), self._build(rows[~inside])


class Search:
    """The best ``k`` of a tree for each of a block of queries."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, relax: float):
        self.tree, self.query_ids, self.queries, self.k, self.relax = tree, ids, queries, k, relax
        self.squares = np.einsum("ij,ij->i", queries, queries)
        self.best = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self._visit(tree.root, np.arange(len(ids)))

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for first in range(0, len(node), LEAF):
                self._scan(node[first : first + LEAF], active)
            return
        vantage, border, inside, outside = node
        away = near_distances(self.queries[active], self.tree.vectors[vantage])
        near_inside = away <= border
        for half, other, mine in ((inside, outside, near_inside), (outside, inside, ~near_inside)):
            some, gap = active[mine], np.abs(away[mine] - border)
            self._visit(half, some)
            reach = self.best[some, -1] * self.relax
            self._visit(other, some[gap <= reach + SLACK * (1 + away[mine])])

    def _scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        """A matrix product tells which pairs can be among the best; only their distances are computed exactly."""
        vectors, ids = self.tree.vectors[rows], self.tree.ids[rows]
        both = self.squares[active][:, None] + self.tree.squares[rows][None, :]
        rough = both - 2 * (self.queries[active] @ vectors.T)
        reach = self.best[active, -1][:, None] ** 2
        near = rough <= reach + SLACK * (both + np.where(np.isfinite(reach), reach, 0))
        near &= self.query_ids[active][:, None] != ids[None, :]
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            return
        i, j = np.nonzero(near[hit])
        away = np.full((len(hit), len(rows)), np.inf)
        away[i, j] = distances(vectors[j], self.queries[active[hit[i]]])
        some = active[hit]
        best = np.concatenate([self.best[some], away], axis=1)
        found = np.concatenate([self.found[some], np.broadcast_to(ids, away.shape)], axis=1)
        order = np.lexsort((found, best), axis=1)[:, : self.k]
        self.best[some] = np.take_along_axis(best, order, axis=1)
        self.found[some] = np.take_along_axis(found, order, axis=1)


def usable(vector: Column) -> Column:
    """False for vectors that take no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _asked(tree: Tree, part: pa.RecordBatch, k: int, relax: float) -> pa.RecordBatch:
    queries = part.column("id").to_numpy()
    search = Search(tree, queries, _matrix(part.column("vector")), k, relax)
    query, slot = np.nonzero(np.isfinite(search.best))
    columns = {"query_id": queries[query], "id": search.found[query, slot], "score": search.best[query, slot]}
    return pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    relax: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest other rows of each row for which ``is_query`` holds."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = cut_lineage(rows.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")))
    counted = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = counted.orderBy(F.desc("n"), "size").first()
    size, n = (most["size"], most["n"]) if most else (0, 0)
    shards = max(1, -(-n // shard_rows))
    # a shard is searched in a few copies, each for some of the queries, where there are fewer shards than tasks
    copies = max(1, rows.sparkSession.sparkContext.defaultParallelism // shards)
    rows = rows.where(F.size("vector") == size)
    place = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = rows.select("id", "vector", place(shards, 1).alias("shard"), F.lit(0).alias("kind")).withColumn("copy", every(copies))
    asked = rows.where("asks").select("id", "vector", place(copies, 2).alias("copy"), F.lit(1).alias("kind")).withColumn("shard", every(shards))
    # vectors come first and make the tree of their shard; queries then stream past it
    together = dealt.unionByName(asked).repartition(shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches):
        tree, held, at = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("shard", "copy", "kind")]
            changes = np.any([np.diff(x) != 0 for x in keys], axis=0)
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                shard, copy, kind = (x[start] for x in keys)
                if (shard, copy) != at:
                    tree, held, at = None, [], (shard, copy)
                if kind == 0:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("vector"))))
                    continue
                if tree is None and held:
                    ids, matrix = (np.concatenate(x) for x in zip(*held))
                    order, held = np.argsort(ids), []
                    tree = Tree(ids[order], matrix[order])
                for first in range(0, part.num_rows if tree else 0, query_rows):
                    yield _asked(tree, part.slice(first, query_rows), k, relax)

    found = together.mapInArrow(run, "query_id long, id long, score double")
    # k rows of each shard and query are left; a rank within a query is bounded by k times the shards
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
