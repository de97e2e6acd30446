from pyspark.sql import functions as F

from strataquery.sources.store import PartitionStore
from strataquery.streaming import events


def stream(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "events")
    rows.repartitionByRange(3, "event_id").write.parquet(folder)
    return rows, events.read_stream(spark, folder, rows.schema, files_per_trigger=1)


def drained(frame, tmp_path, name, mode):
    frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.table(name)


# Files come in any order, so rows are late by up to the whole span of the table.
def test_windows_of_the_stream_equal_the_batch(spark, sf, tmp_path):
    rows, live = stream(spark, sf, tmp_path)
    got = drained(events.tumbling(live, "1 day", delay="60 days"), tmp_path, "tumbling", "complete")
    plain = lambda d: sorted((str(r["start"]), r["event_type"], r["events"], round(r["total"], 6)) for r in d.collect())
    assert plain(got) == plain(events.tumbling(rows, "1 day"))


def test_sessions_of_the_stream_equal_the_batch(spark, sf, tmp_path):
    rows, live = stream(spark, sf, tmp_path)
    got = drained(events.sessions(live, "6 hours", delay="60 days"), tmp_path, "sessions", "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, events.sessions(rows, "6 hours").collect()))


def test_distinct_keys(spark, sf, tmp_path):
    rows, live = stream(spark, sf, tmp_path)
    twice = live.unionByName(live)
    got = drained(events.distinct(twice, ["event_id"], delay="60 days"), tmp_path, "distinct", "append")
    assert got.count() == rows.count() == got.select("event_id").distinct().count()


def test_refresh_commits_each_batch_once(spark, sf, tmp_path):
    rows, live = stream(spark, sf, tmp_path)
    store = PartitionStore(spark, str(tmp_path / "store"), {"files": "file_id string, path string"})

    def apply(batch, number):
        made = batch.select(F.col("event_id").cast("string").alias("file_id"), F.col("event_type").alias("path"))
        store.commit({"files": made}, replaced=made)

    for _ in range(2):
        events.refresh(live, apply, str(tmp_path / "check")).awaitTermination()
    assert store.read("files").count() == rows.count()
