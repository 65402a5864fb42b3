"""Run reports over a table of stage events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Reported percentiles as fractions of the sorted position.
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95}
BINS = 256


def order_statistics(
    values: DataFrame, key: str, value: str, fractions: Mapping[str, float] = PERCENTILES, bins: int = BINS
) -> DataFrame:
    """The exact sorted value at position ``int(n * fraction)`` per key.

    Equal values are counted, the counts are binned between the quantiles of a
    sketch, so bins hold about as many values each however they are spread, and
    only the bin that holds a position is put in order: no task sorts a whole key.
    """
    held = values.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    counted = held.groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    steps = [i / bins for i in range(1, bins)]
    ranges = held.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.array_distinct(F.percentile_approx("_v", steps, 10 * bins)).alias("_edges")
    )
    below = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    binned = counted.join(ranges, key).withColumn("_bin", below).drop("_edges")
    per_bin = binned.groupBy(key, "_bin", "_n").agg(F.sum("_c").alias("_in_bin"))
    before = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # <= bins rows a key
    placed = per_bin.withColumn("_before", F.coalesce(F.sum("_in_bin").over(before), F.lit(0)))
    wanted = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("name"), F.floor(F.col("_n") * f).cast("long").alias("position"))
                for name, f in fractions.items()
            ]
        )
    )
    targets = (
        placed.select(key, "_bin", "_before", "_in_bin", wanted.alias("w"))
        .where((F.col("w.position") >= F.col("_before")) & (F.col("w.position") < F.col("_before") + F.col("_in_bin")))
        .select(key, "_bin", F.col("w.name").alias("_name"), (F.col("w.position") - F.col("_before")).alias("_at"))
    )
    in_bin = binned.join(targets.select(key, "_bin").distinct(), [key, "_bin"], "left_semi")
    running = Window.partitionBy(key, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = in_bin.withColumn("_end", F.sum("_c").over(running)).select(key, "_bin", "_v", "_c", "_end")
    hit = ends.join(targets, [key, "_bin"]).where(
        (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_c"))
    )
    return hit.groupBy(key).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in fractions]
    )


def run_report(events: DataFrame, fractions: Mapping[str, float] = PERCENTILES) -> DataFrame:
    """Per stage: events, successes, success rate, latency statistics, throughput and status.

    ``events`` holds (stage, ok, ms) and may hold chunk_count.
    """
    chunks = F.avg("chunk_count") if "chunk_count" in events.columns else F.lit(None).cast("double")
    n, ok = F.count(F.lit(1)), F.count(F.when(F.col("ok"), 1))
    totals = events.groupBy("stage").agg(
        n.alias("events"),
        ok.alias("success"),
        (n - ok).alias("failure"),
        (ok * 100.0 / n).alias("success_rate_pct"),
        F.avg("ms").alias("avg_ms"),
        chunks.alias("avg_chunks"),
        (n * 1000.0 / F.sum("ms")).alias("throughput_per_s"),
        F.when(ok == n, "completed").when(ok == 0, "failed").otherwise("partial").alias("status"),
    )
    return totals.join(order_statistics(events, "stage", "ms", fractions), "stage", "left")


def run_errors(events: DataFrame) -> DataFrame:
    return events.where(F.col("error").isNotNull()).select("stage", "paper", "error")
