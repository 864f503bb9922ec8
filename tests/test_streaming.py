import random
import time

import pytest
from helpers import clicks, random_clicks, rows
from pyspark.sql import functions as F

from clicktide.operators import stats
from clicktide.sources.messages import read_stream, to_messages
from clicktide.streaming import pipeline, sinks

ALL = pipeline.ALL_AVAILABLE
BASE = 1_700_000_400_000  # a full minute


def write_messages(data, path):
    messages = to_messages(data.select(*pipeline.RAW_COLUMNS)).select("value")
    messages.coalesce(1).write.mode("append").text(path)


def wait(*queries):
    for q in queries:
        q.awaitTermination()


def at(spark, minutes_and_items):
    made = [
        (i, BASE + int(minute * 60_000), 1, "view", item, None)
        for i, (minute, item) in enumerate(minutes_and_items)
    ]
    return spark.createDataFrame(
        made, "id long, timestamp long, visitorid long, event string, itemid long, transactionid long"
    )


def test_pipeline_equals_batch(spark, tmp_path):
    data = clicks(spark, random_clicks(random.Random(11), 400, 10, 12))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    write_messages(data, source)
    poison = '{"timestamp":9223372036854775807,"visitorid":1,"event":"view","itemid":1,"transactionid":null}'
    spark.createDataFrame([("broken {",), (poison,)], "value string").write.mode("append").text(source)
    queries = pipeline.start_pipeline(read_stream(spark, "files", path=source), root, str(tmp_path / "cp"), ALL)
    assert sorted(q.name for q in queries) == ["dead_letters", "event_statistics", "raw_events", "windowed_stats"]
    pipeline.await_all(spark, queries)

    raw = spark.read.parquet(f"{root}/live_clickstream_events")
    assert raw.count() == 400
    windows = sinks.read_upserts(spark, f"{root}/windowed_stats", pipeline.WINDOW_KEYS)
    columns = ["window_start", "window_end", "event", "event_count", "unique_users", "unique_items"]
    order = ("window_start", "event")
    assert rows(windows.select(columns), *order) == rows(stats.windowed_stats(data).select(columns), *order)
    totals = sinks.read_upserts(spark, f"{root}/event_statistics", pipeline.TOTAL_KEYS)
    assert rows(totals.drop("updated_at"), "event") == rows(
        stats.event_statistics(data).drop("updated_at"), "event"
    )
    dead = spark.read.json(f"{root}/error_data")
    assert sorted(r.raw_message for r in dead.collect()) == ["broken {", poison]
    assert {r.error_message for r in dead.collect()} == {"JSON parsing failed"}


def test_restart_resumes(spark, tmp_path):
    data = clicks(spark, random_clicks(random.Random(12), 100, 5, 6))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (data.where("id < 60"), data.where("id >= 60"), None):
        if part is not None:
            write_messages(part, source)
        queries = pipeline.start_pipeline(
            read_stream(spark, "files", path=source), root, str(tmp_path / "cp"), ALL
        )
        wait(*queries)
    assert spark.read.parquet(f"{root}/live_clickstream_events").count() == 100
    totals = sinks.read_upserts(spark, f"{root}/event_statistics", pipeline.TOTAL_KEYS)
    assert totals.agg(F.sum("total_count")).first()[0] == 100


def test_totals_are_exact_for_many_visitors(spark, tmp_path):
    """More visitors than a sketch counts exactly, most of them in both batches."""
    made = spark.range(12_000).select(
        "id", (F.lit(BASE) + F.col("id")).alias("timestamp"), (F.col("id") % 6007).alias("visitorid"),
        F.lit("view").alias("event"), (F.col("id") % 5003).alias("itemid"), F.lit(None).cast("long").alias("transactionid"),
    )
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (made.where("id < 6500"), made.where("id >= 6500")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        write = sinks.upsert_batches(target, "updated_at")
        pipeline.stream_event_statistics(stream, write, str(tmp_path / "cp"), ALL).awaitTermination()
    totals = sinks.read_upserts(spark, target, pipeline.TOTAL_KEYS).drop("updated_at")
    assert rows(totals) == [("view", 12_000, 6007, 5003)]


def test_rate_limit(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        write_messages(clicks(spark, [(i, "view", 1)]), source)
    messages = read_stream(spark, "files", path=source, maxFilesPerTrigger=1)
    query = pipeline.consume(messages, str(tmp_path / "out"), str(tmp_path / "cp"), ALL)
    wait(query)
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [1, 1, 1]
    assert spark.read.parquet(str(tmp_path / "out" / "clickstream_events")).count() == 3


def test_late_events(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    phases = [[(60, 1)], [(60 + 10 / 60, 1)], [(48.5, 2), (30, 3)]]
    dropped = 0
    for phase in phases:
        at(spark, phase).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        query = pipeline.stream_windowed_stats(
            stream.withColumn("event_time", F.timestamp_millis("timestamp")),
            sinks.upsert_batches(target, "created_at"), str(tmp_path / "cp"), ALL,
        )
        wait(query)
        dropped += sum(
            s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]
        )
    got = sinks.read_upserts(spark, target, pipeline.WINDOW_KEYS)
    minute = (F.unix_millis("window_start") - BASE) / 60_000
    starts = {r[0]: r[1] for r in got.select(minute, "event_count").collect()}
    assert starts == {**{m: 2 for m in range(56, 61)}, 46: 1, 47: 1, 48: 1}
    assert dropped == 7


def test_upserts(spark, tmp_path):
    target = str(tmp_path / "t")
    write = sinks.upsert_batches(target, "written_at")

    def batch(**values):
        return spark.createDataFrame(list(values.items()), "event string, n long")

    def state():
        return dict(rows(sinks.read_upserts(spark, target, ["event"]).select("event", "n")))

    with pytest.raises(FileNotFoundError):
        state()
    write(batch(a=1, b=2), 0)
    write(batch(b=5, c=3), 1)
    assert state() == {"a": 1, "b": 5, "c": 3}
    write(batch(b=5, c=3), 1)  # replay
    assert state() == {"a": 1, "b": 5, "c": 3}
    assert sinks.compact_upserts(spark, target, ["event"]) == 1
    assert state() == {"a": 1, "b": 5, "c": 3}
    write(batch(a=9), 2)
    assert state() == {"a": 9, "b": 5, "c": 3}
    assert sinks.compact_upserts(spark, target, ["event"]) == 2
    assert state() == {"a": 9, "b": 5, "c": 3}
    sinks.drop_folded(spark, target)
    assert [p.name for p in (tmp_path / "t" / "snapshots").iterdir()] == ["upto=2"]
    write(batch(d=4), 3)
    assert state() == {"a": 9, "b": 5, "c": 3, "d": 4}


def test_upserts_compact_themselves(spark, tmp_path):
    target = str(tmp_path / "t")
    write = sinks.upsert_batches(target, "written_at", ["event"], compact_every=5)
    for i in range(50):
        write(spark.createDataFrame([(f"e{i % 7}", i)], "event string, n long").coalesce(1), i)
        if i in (4, 17):
            write(spark.createDataFrame([(f"e{i % 7}", i)], "event string, n long").coalesce(1), i)  # replay
    assert len(list((tmp_path / "t" / "changes").glob("batch_id=*"))) <= 10
    assert len(list((tmp_path / "t" / "snapshots").glob("upto=*"))) <= 2
    state = dict(rows(sinks.read_upserts(spark, target, ["event"]).select("event", "n")))
    assert state == {f"e{i % 7}": i for i in range(50)}


def test_replay_key_tells_rows_of_a_batch_apart(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    first = sorted(tuple(r) for r in sinks.with_replay_key(batch, 7).select("batch_id", "row_hash", "copy").collect())
    again = sorted(tuple(r) for r in sinks.with_replay_key(batch.repartition(2), 7).select("batch_id", "row_hash", "copy").collect())
    assert first == again and len(set(first)) == 3


def test_failed_batches_are_kept(spark, tmp_path):
    def refuse(batch, batch_id):
        raise ConnectionError("connection refused")

    dead, errors = str(tmp_path / "dead"), str(tmp_path / "errors")
    run = sinks.guarded(refuse, sinks.store_failure(dead, errors, "windowed_stats"))
    batch = clicks(spark, [(1, "view", 1), (2, "view", 2)])
    run(batch, 3)
    run(batch, 3)  # a replay replaces, it does not add
    kept = spark.read.json(dead)
    assert kept.count() == 2
    assert {(r.batch_id, r.error_message) for r in kept.collect()} == {(3, "ConnectionError: connection refused")}
    record = sinks.read_errors(spark, errors).first()
    assert (record.error_type, record.severity, record.batch_id, record.status) == (
        "db_connection", "CRITICAL", 3, "pending"
    )
    assert '"table":"windowed_stats"' in record.raw_data


def test_failure_of_the_dead_letters_stops_the_query(spark, tmp_path):
    def refuse(*_):
        raise OSError("disk full")

    source = str(tmp_path / "in")
    write_messages(clicks(spark, [(1, "view", 1)]), source)
    valid, _ = pipeline.parse_events(read_stream(spark, "files", path=source))
    query = pipeline.stream_clicks(valid, sinks.guarded(refuse, refuse), str(tmp_path / "cp"), ALL)
    with pytest.raises(Exception, match="disk full"):
        pipeline.await_all(spark, [query])
