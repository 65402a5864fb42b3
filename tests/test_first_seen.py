"""First-seen rows over several runs of a stream."""

import random

from pyspark.sql import functions as F

from paperlake.operators.quality import first_seen
from paperlake.streaming.jobs import first_seen_forever, keep_state_in_rocksdb, read_files, run_available

SCHEMA = "seq long, doi string, title string, more array<string>"


def items(seed, n):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        doi = r.choice([None, "", *(f"10/{r.randrange(n // 3)}" for _ in range(4))])
        title = r.choice([None, "", "Hot title", " hot TITLE", *(f"Title {r.randrange(n // 2)}" for _ in range(6))])
        rows.append((k, "10/hot" if r.random() < 0.3 else doi, title, [str(k)]))
    return rows


def test_runs_over_split_input_equal_one_table(spark, tmp_path):
    keep_state_in_rocksdb(spark)
    rows = items(4, 240)
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    seen = []
    for run, part in enumerate((rows[:90], rows[90:91], rows[91:])):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
        stream = first_seen_forever(read_files(spark, source, spark.createDataFrame([], SCHEMA).schema))
        found = run_available(stream, out, state)
        assert found.columns == ["seq", "doi", "title", "more"]
        held = rows[: (90, 91, 240)[run]]
        seen.append({r.seq for r in found.collect()})
        assert seen[-1] == {r.seq for r in first_seen(spark.createDataFrame(held, SCHEMA)).collect()}
    assert seen[0] <= seen[1] <= seen[2]  # what was let through stays
    again = run_available(first_seen_forever(read_files(spark, source, spark.createDataFrame([], SCHEMA).schema)), out, state)
    assert {r.seq for r in again.collect()} == seen[2]  # nothing new


def test_copies_are_thinned_before_the_shuffle(spark, tmp_path):
    """A key that a third of all rows share leaves each batch of a task once."""
    keep_state_in_rocksdb(spark)
    df = spark.range(30_000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "10/hot").otherwise(F.concat(F.lit("10/"), "id")).alias("doi"),
        F.concat(F.lit("t"), "id").alias("title"), F.array(F.lit("x")).alias("more"),
    )
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = first_seen_forever(read_files(spark, str(tmp_path / "in"), df.schema))
    found = run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert found.where("doi = '10/hot'").collect()[0].seq == 0 and found.count() == 20_001
