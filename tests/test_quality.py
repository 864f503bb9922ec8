import random

import pytest
from helpers import clicks, rows

from clicktide import schema as S
from clicktide.operators import errors, profiles, quality, stats
from clicktide.operators.views import create_views


def test_classifier(spark):
    cases = [
        ("JSON parse error", "json_parse", "INFO"),
        ("Connection timeout", "db_connection", "CRITICAL"),
        ("read TIMEOUT", "timeout", "WARNING"),
        ("duplicate key", "constraint_violation", "ERROR"),
        ("boom", "unknown", "ERROR"),
    ]
    df = spark.createDataFrame([(m,) for m, _, _ in cases], "error_message string")
    got = {r.error_message: (r.error_type, r.severity) for r in errors.classify_errors(df).collect()}
    assert got == {m: (t, s) for m, t, s in cases}


def test_error_rows_and_alerts(spark):
    df = spark.createDataFrame(
        [("x" * 1500 + " connect", 0, None), ("timeout", None, "{}"), ("boom", None, None)],
        "error_message string, batch_id long, raw_data string",
    )
    stored = errors.error_events(df)
    assert sorted(len(r.error_message) for r in stored.collect()) == [4, 7, 1508]
    cut = errors.error_events(df, max_chars=1000)
    # classified by the whole text, also where less of it is stored
    assert rows(cut.where("length(error_message) = 1000").select("error_type", "retry_count", "status")) == [
        ("db_connection", 0, "pending")
    ]
    alerts = {r.color: r for r in errors.error_alerts(stored).collect()}
    assert set(alerts) == {"danger", "warning"}
    assert len(alerts["danger"].text) == 1508 and alerts["danger"].batch_id == "0"
    assert {len(r.text) for r in errors.error_alerts(stored, S.ALERT_MESSAGE_CHARS).collect()} == {500, 4}
    assert alerts["danger"].title == ":rotating_light: CRITICAL - db_connection"
    assert alerts["warning"].batch_id == "N/A"


def test_failed_message_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert errors.failed_message_count(spark, path) == 0
    sent = spark.createDataFrame([("1", '{"timestamp":1,"visitorid":1}'), ("2", "{}")], "key string, value string")
    for _ in range(2):
        errors.log_failed_messages(errors.failed_messages(sent, "TimeoutError", "no answer"), path)
    day = rows(errors.failed_message_counts(spark, path))[0][0]
    assert errors.failed_message_count(spark, path, str(day)) == 4
    assert errors.failed_message_count(spark, path, "1999-01-01") == 0


def test_publish(spark, tmp_path):
    log = str(tmp_path / "log")
    messages = spark.createDataFrame([("1", "{}"), ("2", "not json"), (None, "{}")], "key string, value string")
    assert errors.publish(messages, lambda key, value: None, log) == (3, 0)
    assert errors.failed_message_count(spark, log) == 0

    def refuse(key, value):
        if key == "2":
            raise TimeoutError("no answer")

    assert errors.publish(messages, refuse, log) == (2, 1)
    (row,) = errors.read_failed_messages(spark, log).collect()
    assert (row.partition_key, row.raw_message, row.error.type) == ("2", "not json", "TimeoutError")
    logged = errors.read_failed_messages(spark, log)
    assert {(r.error["type"], r.error["message"]) for r in logged.collect()} == {("TimeoutError", "no answer")}


def test_handle_errors(spark, tmp_path):
    df = spark.createDataFrame(
        [("bad JSON", 1, None), ("no connection", 2, None)], "error_message string, batch_id long, raw_data string"
    )
    for _ in range(2):
        alerts = errors.handle_errors(df, str(tmp_path / "errors"))
    assert [r.title for r in alerts.collect()] == [":rotating_light: CRITICAL - db_connection"]
    stored = spark.read.parquet(str(tmp_path / "errors"))
    assert stored.schema.fieldNames() == S.ERROR_EVENTS.fieldNames() and stored.count() == 4


def test_views(spark):
    data = clicks(spark, [(1, "view", 1), (1, "addtocart", 2), (2, "view", 2)])
    create_views(data, stats.windowed_stats(data), stats.event_statistics(data))
    assert rows(spark.sql("SELECT event, event_count FROM event_summary"), "event") == [
        ("addtocart", 1), ("view", 2)
    ]
    assert spark.sql("SELECT * FROM realtime_metrics").count() > 0
    assert rows(spark.sql("SELECT event FROM latest_stats")) == [("view",), ("addtocart",)]


def test_duplicates_and_vocabulary(spark):
    data = clicks(spark, [(1, "view", 1), (1, "view", 2), (2, "signup", 1)])
    copies = data.unionByName(data.where("id = 1")).unionByName(data.where("id = 1"))
    assert [r[-1] for r in rows(quality.duplicate_events(copies))] == [3]
    assert rows(quality.duplicate_events(data)) == []
    assert rows(quality.invalid_event_types(data)) == [("signup", 1)]


def test_report_and_fail_fast(spark):
    good = clicks(spark, [(1, "view", 1), (2, "transaction", 1)])
    assert all(r.passed for r in quality.data_quality_report(good, fail_fast=True).collect())
    bad = good.unionByName(good).unionByName(clicks(spark, [(3, "error", 1)]))
    report = {r.check_name: r.n_bad for r in quality.data_quality_report(bad).collect()}
    assert report == {"not_empty": 0, "duplicates": 2, "event_types": 1, "required_values": 0}
    with pytest.raises(quality.DataQualityError, match="duplicates: 2"):
        quality.data_quality_report(bad, fail_fast=True)
    empty = {r.check_name: r.passed for r in quality.data_quality_report(good.limit(0)).collect()}
    assert empty["not_empty"] is False


def test_constraints(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (1, "bbb", 2), (None, "c", 2), (1, "d", 3)], "k long, s string, v long"
    )
    got = dict(rows(quality.constraint_violations(df, ("k", "v"), (("k",), ("v",)), {"s": 2})))
    assert got == {"not_null(k)": 1, "not_null(v)": 1, "length(s<=2)": 1, "unique(k)": 2, "unique(v)": 1}


def test_schema_and_table_checks(spark):
    data = clicks(spark, [(1, "view", 1)])
    row = quality.validate_schema(data, {"id": "bigint", "event": "int", "gone": "string"}).first()
    assert (row.missing_columns, row.mistyped_columns, row.passed) == ("gone", "event", False)
    with pytest.raises(quality.DataQualityError):
        quality.validate_table(spark, "no_such_table")
    assert quality.sample_check(data) == 1
    with pytest.raises(quality.DataQualityError):
        quality.sample_check(data.limit(0))
    with pytest.raises(quality.DataQualityError):
        quality.sample_check(data.drop("itemid"))


def test_rates_over_zero(spark):
    nothing = clicks(spark, [(1, "signup", 1)])
    funnel = stats.conversion_funnel(stats.event_statistics(nothing)).first()
    assert (funnel.views, funnel.view_to_cart_rate, funnel.overall_conversion_rate) == (0, None, None)
    ctr = profiles.ctr_stats(nothing).first()
    assert (ctr.view_to_cart_rate, ctr.overall_conversion_rate) == (0.0, 0.0)
    empty = stats.conversion_funnel(stats.event_statistics(nothing.limit(0))).first()
    assert (empty.views, empty.view_to_cart_rate) == (0, None)


def test_points(spark):
    data = clicks(spark, [(1, "view", 1), (1, "addtocart", 2), (2, "transaction", 2)])
    assert rows(profiles.user_profile(data, 1)) == [(1, 2, 1, 0)]
    assert rows(profiles.user_profile(data, 9)) == []
    assert rows(profiles.item_stats(data, 2)) == [(2, 2, 2, 0, 1, 1, 0.5)]
    assert [r.itemid for r in profiles.user_history(data, 1, 1).collect()] == [2]


def test_windows_match_the_built_in_function(spark):
    import random

    from helpers import random_clicks
    from pyspark.sql import functions as F

    made = [(v, e, i) for v, e, i in random_clicks(random.Random(4), 300, 5, 6, hot=1)]
    data = clicks(spark, made).withColumn(
        "timestamp", F.col("timestamp") + F.pmod(F.xxhash64("id"), F.lit(1_800_000)) - 900_000
    )
    want = (
        data.groupBy(F.window(F.timestamp_millis("timestamp"), "5 minutes", "1 minute"), "event")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("visitorid").alias("u"),
            F.count_distinct("itemid").alias("i"),
        )
        .select("window.start", "window.end", "event", "n", "u", "i")
    )
    for approx in (False, True):
        got = stats.windowed_stats(data, approx=approx)
        assert rows(got, "window_start", "event") == rows(want, "start", "event")


def test_windows_with_missing_values(spark):
    data = spark.createDataFrame(
        [(1, 60_000, None, "view", 5, None), (2, 61_000, 1, None, None, None), (3, -30_000, 1, "view", 5, None)],
        "id long, timestamp long, visitorid long, event string, itemid long, transactionid long",
    )
    got = {(r.window_start.timestamp(), r.event): r for r in stats.windowed_stats(data).collect()}
    at_zero = got[(0.0, "view")]
    assert (at_zero.event_count, at_zero.unique_users, at_zero.unique_items) == (1, 0, 1)
    both = got[(-60.0, "view")]
    assert (both.event_count, both.unique_users, both.unique_items) == (2, 1, 1)
    assert got[(0.0, None)].event_count == 1


def test_windows_do_not_depend_on_the_blocks(spark):
    rng = random.Random(4)
    made = [(i, rng.randrange(-40, 200) * 20_000, rng.randrange(4), "view", rng.choice([1, 2, None]), None) for i in range(300)]
    data = spark.createDataFrame(made, "id long, timestamp long, visitorid long, event string, itemid long, transactionid long")
    want = {}
    for _, ms, visitor, event, item, _ in made:
        pane = ms // 60_000
        for start in range(pane - 4, pane + 1):
            n, users, items = want.setdefault((start, event), [0, set(), set()])
            want[start, event][0] += 1
            users.add(visitor)
            items |= {item} - {None}
    want = sorted((s, e, n, len(u), len(i)) for (s, e), (n, u, i) in want.items())
    for size in (1, 7, 64):
        got = stats._windows_exact(data, 5, 60_000, size).select("start", "event", "event_count", "unique_users", "unique_items")
        assert rows(got, "start") == want


def test_traces_are_those_of_python_and_made_once_per_place(monkeypatch):
    import traceback

    import pyarrow as pa

    made = []

    def deliver(key, value):
        if key == "1":
            raise TimeoutError(f"no answer for {value}")
        if key == "2":
            int(value)
        if key == "3":
            try:
                {}[value]
            except KeyError as missing:
                raise ConnectionError("two at once") from missing

    keys = ["0", "1", "2", "3", "1", "2"] * 20
    batch = pa.RecordBatch.from_pydict({"key": keys, "value": [f"v{i}" for i in range(len(keys))]})
    told = next(errors._deliver([batch], deliver)).to_pydict()
    for key, value, trace in zip(keys, told["value"], told["trace"]):
        try:
            deliver(key, value)
        except Exception:
            ours = traceback.format_exc().split("in deliver\n", 1)[1]  # the callers differ
            if key == "3":
                assert "KeyError" in trace and trace.endswith("ConnectionError: two at once\n")
            else:
                assert trace.split("in deliver\n", 1)[1] == ours
                assert trace.startswith("Traceback (most recent call last):\n")
        else:
            assert trace is None
    whole = traceback.format_tb
    monkeypatch.setattr(errors.traceback, "format_tb", lambda tb: made.append(tb) or whole(tb))
    monkeypatch.setattr(errors.traceback, "format_exc", lambda: pytest.fail("formatted whole"))
    next(errors._deliver([batch], deliver))
    assert len(made) == 2  # two places without a cause
