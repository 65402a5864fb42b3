"""Incremental forms of ingest, first-seen deduplication and period counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from paperlake.functions.text import strip
from paperlake.plans.ingest import index_documents
from paperlake.sources.knowledge_base import BUCKETS, put_documents


def read_files(spark: SparkSession, path: str, schema, max_files: int = 64, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream; a micro-batch takes at most ``max_files`` of them, so a backlog is no one batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.option("pathGlobFilter", pattern).parquet(path)


def ingest_stream(
    docs: DataFrame, path: str, checkpoint: str, strategy: str = "fixed", once: bool = True, buckets: int = BUCKETS, **options
) -> StreamingQuery:
    """Index new (document_id, text) rows as they arrive, for example from ``read_files``, into the tables under ``path``.

    A micro-batch rewrites the partitions that hold its documents; one that is replayed after a failure writes the
    same rows again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read by three tables
        try:
            put_documents(batch.sparkSession, path, index_documents(batch, strategy, **options), buckets)
        finally:
            batch.unpersist()

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _watermarked(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def first_seen_stream(items: DataFrame, key: str = "doi", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first row per key. A key is remembered until the watermark passes it, not for ever."""
    return _watermarked(items, time, delay).dropDuplicatesWithinWatermark([key])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstOfKey(StatefulProcessor):
    """Lets the first row of a key pass, once for all runs; of one micro-batch that with the smallest ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = min(rows, key=lambda row: row.seq)
        if not self.seen.exists():
            self.seen.update((first.seq,))
            yield first

    def close(self) -> None:
        pass


def _first_of_key(items: DataFrame, key: Column) -> DataFrame:
    """The first row per key of a stream; rows with a null key all pass, without a shuffle."""
    keyed = items.withColumn("_key", key)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows of one batch with one key only the first goes on, so copies are gone before the shuffle."""
        for batch in batches:
            table = pa.table({"key": batch.column("_key"), "seq": batch.column("seq"), "at": pa.array(range(batch.num_rows))})
            table = table.sort_by([("seq", "ascending")])
            first = table.group_by("key", use_threads=False).aggregate([("at", "first")])
            yield batch.take(first.column("at_first").combine_chunks())

    thinned = keyed.where("_key IS NOT NULL").mapInArrow(thin, keyed.schema)
    once = thinned.groupBy("_key").transformWithState(_FirstOfKey(), keyed.schema, "Append", "None")
    return keyed.where("_key IS NULL").unionByName(once).select(items.columns)


def first_seen_forever(items: DataFrame) -> DataFrame:
    """A stream of (seq long, doi, title, ...) as ``operators.quality.first_seen`` takes a table, over all runs of one checkpoint.

    A row whose DOI came before is dropped, and of the rest one whose title came before. Keys are kept in RocksDB on
    the workers, in memory only as far as they are in use, and never forgotten; rows of one key in one micro-batch go
    by ``seq``. The session must use that state store, see ``keep_state_in_rocksdb``.
    """
    has_doi = F.coalesce("doi", F.lit("")) != ""
    once = _first_of_key(items, F.when(has_doi, F.col("doi")))
    return _first_of_key(once, F.md5(strip(F.lower(F.coalesce("title", F.lit(""))))))


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State of streams started from now on lies in RocksDB, with changes alone written at each micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def period_counts(
    events: DataFrame, label: str, length: str, slide: str | None = None, time: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Rows per label and period; rows later than ``delay`` are dropped, a period is emitted once it is closed."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = _watermarked(events, time, delay).groupBy(window.alias("period"), F.col(label)).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(
        F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), label, "n"
    )


def run_available(stream: DataFrame, table_path: str, checkpoint: str, prepare: Callable | None = None) -> DataFrame:
    """Drive a stream over all input present now into parquet, and read the result."""
    stream = prepare(stream) if prepare else stream
    query = (
        stream.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(table_path)
