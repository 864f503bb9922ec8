import random
import time

import pytest
from helpers import clicks, random_clicks, rows
from pyspark.sql import functions as F

from clicktide.operators import stats
from clicktide.sources.messages import parsed_messages, read_stream, to_messages
from clicktide.streaming import exact, fanout, panes, pipeline, sinks
from clicktide.streaming.daily import DailyTable

ALL = pipeline.ALL_AVAILABLE
DAY_MS = 86_400_000


def rows_of_day(spark, day, batch, n=20):
    """The same keys of a day, with a value that tells the batch; a stretch of text gives the files some size."""
    return spark.range(n).select(
        F.timestamp_millis(F.lit(day * DAY_MS) + F.col("id") * 60_000).alias("at"),
        F.lit(batch).alias("v"), F.sha2(F.concat(F.lit(batch), F.lit("-"), F.col("id").cast("string")), 512).alias("pad"),
    ).coalesce(1)


def day_name(day):
    return time.strftime("%Y-%m-%d", time.gmtime(day * 86_400))


def test_folds_cost_as_much_as_the_days_they_touch(spark, tmp_path):
    table = DailyTable(spark, str(tmp_path / "t"), F.col("at"), ["at"], fold_after=4)
    costs, counts = [], []
    for batch in range(50):
        # every batch changes today and yesterday; a day goes by every five batches
        day = 100 + batch // 5
        table.write(rows_of_day(spark, day, batch).unionByName(rows_of_day(spark, day - 1, batch)), batch)
        if batch % 5 == 4:
            costs.append(sum(table.fold().values()))
            counts.append(len(list((tmp_path / "t" / "parts").glob("*/*/*.parquet"))) / len(table.manifest().days))
    assert max(costs[2:]) <= 1.2 * min(costs[2:])  # bytes rewritten do not grow with the table
    assert max(counts) <= 14 and counts[-1] <= counts[1]  # nor do files of a day
    # readers of the newest day open only its files
    last = day_name(109)
    opened = table.files(last, last)
    assert opened and all(f"_day={last}" in f for f in opened) and len(opened) < len(table.files())
    assert len(opened) <= 5
    values = {(r.at.strftime("%Y-%m-%d"), r.v) for r in table.read().collect()}
    # each day was written last by the fifth batch of the day after
    assert values == {(day_name(99 + d), min(49, 5 * d + 4)) for d in range(11)}


def test_a_batch_or_fold_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    table = DailyTable(spark, str(tmp_path / "t"), F.col("at"), ["at"])
    assert table.write(rows_of_day(spark, 1, 0), 0) and table.write(rows_of_day(spark, 1, 1, 5), 1)
    assert not table.write(rows_of_day(spark, 1, 9), 1)  # a replay of a batch that is there
    before = rows(table.read(), "at")

    def refuse(*_):
        raise OSError("disk full")

    with monkeypatch.context() as broken:
        broken.setattr(DailyTable, "_publish", refuse)
        for work in (lambda: table.write(rows_of_day(spark, 1, 7), 2), lambda: table.fold(1)):
            with pytest.raises(OSError):
                work()
    assert rows(table.read(), "at") == before  # parts nobody names are not read
    assert table.write(rows_of_day(spark, 2, 2), 2) and table.fold(1)
    assert rows(table.read(last=day_name(1)), "at") == before
    assert len(table.manifest().days[day_name(1)]) == 1
    other = DailyTable(spark, str(tmp_path / "t"), F.col("at"), ["at"])
    stale = other.manifest()
    table.write(rows_of_day(spark, 3, 3), 3)
    with pytest.raises(RuntimeError, match="another writer"):
        other._publish(type(stale)(stale.version + 1, 9, stale.schema, stale.days))


def test_rows_without_keys_or_days(spark, tmp_path):
    table = DailyTable(spark, str(tmp_path / "t"), F.col("at"))
    with pytest.raises(FileNotFoundError):
        table.read()
    undated = rows_of_day(spark, 1, 0, 2).withColumn("at", F.lit(None).cast("timestamp"))
    table.write(rows_of_day(spark, 1, 0, 3).unionByName(undated), 0)
    table.write(rows_of_day(spark, 1, 0, 3), 1)
    table.write(rows_of_day(spark, 1, 0, 0), 2)  # an empty batch
    table.fold(1)
    assert table.read().count() == 8 and table.read(day_name(0)).count() == 6 and table.manifest().batch_id == 2


def test_pane_windows_equal_batch(spark, tmp_path):
    data = clicks(spark, random_clicks(random.Random(5), 900, 12, 9)).withColumn("timestamp", F.col("timestamp") + F.col("id") * 7000)
    source = str(tmp_path / "in")
    stored = panes.pane_table(spark, str(tmp_path / "p"), fold_after=2)
    columns = ["window_start", "window_end", "event", "event_count", "unique_users", "unique_items"]
    for part in (data.where("id < 400"), data.where("id BETWEEN 400 AND 700"), data.where("id > 700")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(data.schema).parquet(source).withColumn("event_time", F.timestamp_millis("timestamp"))
        query = panes.pane_counts(stream).writeStream.outputMode("update").foreachBatch(stored.sink())
        query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(**ALL).start()
        query.awaitTermination()
        stored.fold()
    want = stats.windowed_stats(data).select(columns)
    assert rows(panes.read_windows(stored).select(columns), "window_start", "event") == rows(want, "window_start", "event")
    some = panes.read_windows(stored, "2023-11-14", "2023-11-14").select(columns)
    assert rows(some, "window_start", "event") == rows(want.where("date(window_start) = '2023-11-14'"), "window_start", "event")


def test_panes_copy_no_event(spark):
    data = clicks(spark, [(1, "view", 1)]).withColumn("event_time", F.timestamp_millis("timestamp"))
    plan = panes.pane_counts(data)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan


def test_late_events_of_panes(spark, tmp_path):
    """Minutes: 60 moves the time on; 46 is in a window still open, 45 and 30 are not."""
    base, source = 1_700_000_400_000, str(tmp_path / "in")
    stored = panes.pane_table(spark, str(tmp_path / "p"))
    for part in ([60], [60.2], [46.5, 45.5, 30]):
        made = [(base + int(m * 60_000), 1, "view", 1) for m in part]
        spark.createDataFrame(made, "timestamp long, visitorid long, event string, itemid long").coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).withColumn("event_time", F.timestamp_millis("timestamp"))
        query = panes.pane_counts(stream).writeStream.outputMode("update").foreachBatch(stored.sink())
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(**ALL).start().awaitTermination()
    minute = (F.unix_millis("pane_start") - base) / 60_000
    assert {r[0]: r[1] for r in stored.read().select(minute, "event_count").collect()} == {60: 2, 46: 1}


def test_exact_counts_survive_restarts_and_replays(spark, tmp_path):
    rng = random.Random(8)
    data = clicks(spark, random_clicks(rng, 3000, 400, 300, hot=3)).select("visitorid", "event", "itemid", "id")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (data.where("id < 1000"), data.where("id >= 1000")):
        part.repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = exact.stream_exact_statistics(stream, target, str(tmp_path / "cp"), ALL)
        query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    pairs = data.select("event", "visitorid").distinct().count() + data.select("event", "itemid").distinct().count()
    assert state == pairs + data.select("event").distinct().count()  # one entry per pair and event
    want = data.groupBy("event").agg(F.count(F.lit(1)), F.count_distinct("visitorid"), F.count_distinct("itemid"))
    assert rows(exact.read_exact(spark, target).drop("updated_at"), "event") == rows(want, "event")
    # the last batch once more: it starts from the totals before it
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("batch_id=*"))
    assert len(list((tmp_path / "out").glob("batch_id=*"))) <= 3
    write = exact.add_batch(str(tmp_path / "two"))
    seen = exact.first_seen(data.where("id < 50"))
    for _ in range(2):
        write(seen, last)
    assert exact.read_exact(spark, str(tmp_path / "two")).agg(F.sum("total_count")).first()[0] == 50


# --- one query for all ------------------------------------------------------


def write_messages(data, path):
    to_messages(data.select(*pipeline.RAW_COLUMNS)).select("value").coalesce(1).write.mode("append").text(path)


def test_fan_out_equals_batch_and_counts_what_it_drops(spark, tmp_path):
    data = clicks(spark, random_clicks(random.Random(4), 300, 10, 12))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    old = clicks(spark, [(7, "view", 1), (8, "view", 2)]).withColumn("timestamp", F.col("timestamp") - 2_000_000)
    for part in (data.where("id < 150"), data.where("id >= 150"), old):
        write_messages(part, source)
        spark.createDataFrame([("broken {",)], "value string").coalesce(1).write.mode("append").text(source)
        stream = read_stream(spark, "files", path=source)
        fanout.start_fan_out(stream, root, str(tmp_path / "cp"), ALL).awaitTermination()
    tables = fanout.ClickTables(spark, root)
    assert tables.live.read().count() == 302
    columns = ["window_start", "window_end", "event", "event_count", "unique_users", "unique_items"]
    want = stats.windowed_stats(data).select(columns)
    assert rows(tables.read_windows().select(columns), "window_start", "event") == rows(want, "window_start", "event")
    every = stats.event_statistics(data.unionByName(old)).drop("updated_at")
    assert rows(tables.read_totals(), "event") == rows(every, "event")
    told = rows(tables.read_health().select("batch_id", "messages", "valid", "invalid", "late"), "batch_id")
    assert told == [(0, 151, 150, 1, 0), (1, 151, 150, 1, 0), (2, 3, 2, 1, 2)]
    assert {r.raw_message for r in spark.read.json(f"{root}/error_data").collect()} == {"broken {"}
    tables.fold()
    assert rows(tables.read_windows().select(columns), "window_start", "event") == rows(want, "window_start", "event")


def test_totals_of_the_fan_out_are_exact(spark, tmp_path):
    """More visitors than a sketch counts exactly, most of them in both batches, before and after a fold."""
    made = spark.range(12_000).select(
        F.lit("view").alias("event"), (F.col("id") % 6007).alias("visitorid"), (F.col("id") % 5003).alias("itemid"),
        F.lit(True).alias("valid"), "id",
    )
    tables = fanout.ClickTables(spark, str(tmp_path / "out"), fold_after=1)
    for batch, part in enumerate((made.where("id < 6500"), made.where("id >= 6500"))):
        tables.write_totals(part, batch)
    assert rows(tables.read_totals()) == [("view", 12_000, 6007, 5003)]
    tables.totals.fold()
    assert rows(tables.read_totals()) == [("view", 12_000, 6007, 5003)]


def test_a_restart_between_two_sinks_repeats_neither(spark, tmp_path):
    source, calls, broken = str(tmp_path / "in"), [], [True]
    write_messages(clicks(spark, [(1, "view", 1), (2, "view", 2)]), source)

    def first(parsed, batch_id):
        calls.append(("first", batch_id, parsed.count()))

    def second(parsed, batch_id):
        if broken[0]:
            raise OSError("disk full")
        calls.append(("second", batch_id, parsed.count()))

    def start():
        write = fanout.fan_out(parsed_messages, {"first": first, "second": second}, str(tmp_path / "ledger"))
        writer = read_stream(spark, "files", path=source).writeStream.foreachBatch(write)
        return writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(**ALL).start()

    with pytest.raises(Exception, match="disk full"):
        pipeline.await_all(spark, [start()])
    broken[0] = False
    start().awaitTermination()
    assert calls == [("first", 0, 2), ("second", 0, 2)]


def test_a_batch_is_parsed_once(spark, tmp_path):
    source, plans = str(tmp_path / "in"), []
    write_messages(clicks(spark, [(1, "view", 1)]), source)

    def look(parsed, batch_id):
        parsed.count()
        plan = parsed.where("valid").groupBy("event").count()._jdf.queryExecution().executedPlan().toString()
        plans.append(plan)

    write = fanout.fan_out(parsed_messages, {"a": look, "b": look}, str(tmp_path / "ledger"))
    writer = read_stream(spark, "files", path=source).writeStream.foreachBatch(write)
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(**ALL).start().awaitTermination()
    assert len(plans) == 2 and all("InMemoryTableScan" in p for p in plans)


def test_a_failed_fold_fails_no_batch(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise OSError("disk full")

    monkeypatch.setattr(sinks, "compact_upserts", refuse)
    failed = []
    write = sinks.guarded(sinks.upsert_batches(str(tmp_path / "t"), "written_at", ["event"], compact_every=1), lambda *x: failed.append(x))
    write(spark.createDataFrame([("a", 1)], "event string, n long"), 0)
    assert failed == [] and sinks.read_upserts(spark, str(tmp_path / "t"), ["event"]).count() == 1
