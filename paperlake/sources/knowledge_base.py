"""The document, chunk and embedding tables: changes as functions of frames, and plain Parquet tables that keep them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlake.functions.text import text_of
from paperlake.session import cut_lineage, folder_exists, remove_folder

TABLES = ("documents", "chunks", "embeddings")
BUCKETS = 64  # partitions of a table by document; a table of 100 TB wants some tens of thousands


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def upsert(table: DataFrame, updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``table`` with ``updates`` put over it by key; the last update of a key (by ``order``) wins."""
    latest = last_per_key(updates, keys, [order])
    kept = table.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest.select(*table.columns))


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def existed(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Each id with whether the table holds it."""
    present = table.select(key).distinct().withColumn("existed", F.lit(True))
    return ids.select(key).distinct().join(present, key, "left").withColumn(
        "existed", F.coalesce("existed", F.lit(False))
    )


def newest_first(documents: DataFrame) -> DataFrame:
    return documents.orderBy(F.desc("created_at"), "document_id")


def search_documents(documents: DataFrame, text: str) -> DataFrame:
    """Documents whose title holds ``text``, in any case."""
    return documents.where(text_of("title").contains(text.lower()))


def newest_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given documents, newest first."""
    return newest_first(rows_of(documents, ids))


def rows_of(table: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    """The rows of ``table`` whose key is among ``ids``."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def chunks_in_order(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return rows_of(chunks, ids).orderBy("document_id", "chunk_index")


def indexed_over(tables: Mapping[str, DataFrame], made: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` with the frames of ``index_documents`` put over them: a document loses all that it had before."""
    again = made["documents"].select("document_id")
    return {name: delete_rows(tables[name], again, "document_id").unionByName(made[name]) for name in TABLES}


def without_documents(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the given documents, their chunks and embeddings."""
    return {name: delete_rows(tables[name], ids, "document_id") for name in TABLES}


def without_chunks(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the given chunks (chunk_id) and their embeddings; documents stay."""
    return {name: tables[name] if name == "documents" else delete_rows(tables[name], ids, "chunk_id") for name in TABLES}


# --- tables in folders, partitioned by a hash of the document --------------------


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_tables(tables: Mapping[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """Each table as Parquet under ``path``, partitioned by a hash of the document; what was there is replaced."""
    for name, frame in tables.items():
        frame.withColumn("bucket", _bucket("document_id", buckets)).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{path}/{name}")
        _keep_schema(frame, f"{path}/{name}")


def _keep_schema(frame: DataFrame, path: str) -> None:
    """An empty file, so that a table of which no row is left can still be read."""
    frame.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/bucket=-1")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}").drop("bucket") for name in TABLES}


def put_documents(spark: SparkSession, path: str, made: Mapping[str, DataFrame], buckets: int = BUCKETS) -> None:
    """Put newly indexed documents into the tables under ``path``; ``buckets`` must be that of the tables.

    Only partitions that hold one of the documents are read and written again. Doing it twice changes nothing, so a
    write that was broken off can be repeated; a document that comes twice in ``made`` counts once.
    """
    once = made["documents"].withColumn("_order", F.xxhash64(*made["documents"].columns))
    made = {**made, "documents": last_per_key(once, ["document_id"], ["_order"]).drop("_order")}
    made["chunks"], made["embeddings"] = (made[name].dropDuplicates(["chunk_id"]) for name in ("chunks", "embeddings"))
    ids = made["documents"].select("document_id")
    for name in TABLES:
        _rewrite(spark, f"{path}/{name}", ids, made[name], buckets)


def remove_documents(spark: SparkSession, path: str, ids: DataFrame, buckets: int = BUCKETS) -> None:
    """Delete documents, their chunks and embeddings from the tables under ``path``."""
    for name in TABLES:
        _rewrite(spark, f"{path}/{name}", ids.select("document_id"), None, buckets)


def _rewrite(spark: SparkSession, path: str, gone: DataFrame, new: DataFrame | None, buckets: int) -> None:
    touched = [r.bucket for r in gone.select(_bucket("document_id", buckets).alias("bucket")).distinct().collect()]  # few
    rows = None if new is None else new.withColumn("bucket", _bucket("document_id", buckets))
    old = folder_exists(spark, path)
    if old:
        held = delete_rows(spark.read.parquet(path).where(F.col("bucket").isin(touched)), gone, "document_id")
        rows = held if rows is None else held.unionByName(rows)
    if rows is None:
        return
    rows = cut_lineage(rows)  # the partitions that are written are also read
    left = {r.bucket for r in rows.select("bucket").distinct().collect()}
    writer = rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(path)
    if not old:
        _keep_schema(rows.drop("bucket"), path)
    for bucket in set(touched) - left:  # a partition of which no row is left is not overwritten
        remove_folder(spark, f"{path}/bucket={bucket}")
