"""Skew-proof building blocks, and the shape of the plans."""

import random

import pytest
from helpers import clicks, random_clicks, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clicktide.operators import errors, features, profiles, quality, recommend, stats
from clicktide.plans import scratch
from clicktide.plans.positions import nth_smallest, with_positions
from clicktide.plans.scratch import materialize, shared_folder
from clicktide.plans.skew import lookup_join, semi_join
from clicktide.sources.messages import parse_events

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_join_equals_left_join(spark):
    big = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k")
    )
    table = big.groupBy("k").agg(F.count("*").alias("n")).where("k <> 11").withColumn("label", F.col("k") * 2)
    want = rows(big.join(table, "k", "left").select("id", "k", "n", "label"), "id")
    for hot_keys in (1, 3, 1000):
        got = lookup_join(big, table, "k", "n", spread_by=["id"], hot_keys=hot_keys)
        assert rows(got.select("id", "k", "n", "label"), "id") == want


def test_lookup_join_spreads_the_hot_key(spark):
    big = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"))
    table = big.groupBy("k").agg(F.count("*").alias("n"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        joined = lookup_join(big, table, "k", "n", spread_by=["id"], hot_keys=1)
        text = plan(joined)
        counted = joined.select(F.spark_partition_id().alias("p"), "n").rdd.map(lambda r: r.p).countByValue()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "_spread" in text.split("SortMergeJoin")[1].split("]")[0]  # a join key, not a condition
    assert sum(counted.values()) == 4000 and max(counted.values()) < 1000  # half of the rows share one key


def test_semi_join_equals_left_semi(spark):
    big = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    keys = spark.createDataFrame([(2,), (5,), (9,)], "k long")
    got = rows(semi_join(big, keys, "k", spread_by=["id"]), "id")
    assert got == rows(big.join(keys, "k", "left_semi").select("id", "k"), "id")


def test_semi_join_broadcasts_no_copies_of_the_keys(spark):
    """The stored keys are small enough to be broadcast, what they unfold to is 16 times as many."""
    big = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    keys = materialize(spark.range(500).select(F.col("id").alias("k")), "keys")
    text = plan(semi_join(big, keys, "k", spread_by=["id"]))
    assert "SortMergeJoin" in text and "Broadcast" not in text


@pytest.mark.parametrize("keys", [[], ["visitorid"]])
def test_positions_by_range_equal_row_numbers(spark, keys):
    data = clicks(spark, random_clicks(random.Random(3), 800, 20, 30, hot=4))
    plain = with_positions(data, keys, ["timestamp", "id"])
    ranged = with_positions(data, keys, ["timestamp", "id"], max_group_rows=10)
    columns = ["id", "position", "group_size"]
    assert rows(ranged.select(columns), "id") == rows(plain.select(columns), "id")


def test_positions_keep_null_keys(spark):
    data = spark.createDataFrame([(1, None), (2, None), (3, 5)], "id long, k long")
    ranged = with_positions(data, ["k"], ["id"], max_group_rows=1)
    assert rows(ranged.select("id", "position", "group_size"), "id") == [(1, 1, 2), (2, 2, 2), (3, 1, 1)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.integers(-(10**12), 10**12) | st.integers(-3, 3), min_size=1, max_size=40),
    data=st.data(),
)
def test_nth_smallest(spark, values, data):
    n = data.draw(st.integers(0, len(values) - 1))
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    value, smaller = nth_smallest(frame, "v", n, fanout=5 if max(values) - min(values) < 100 else 4096)
    ordered = sorted(values)
    assert value == ordered[n]
    assert smaller == sum(v < ordered[n] for v in values)


def test_scratch_lies_in_the_folder_of_the_session(spark):
    table = materialize(spark.range(3), "probe")
    assert all(shared_folder(spark) in f for f in table.inputFiles())
    assert table.count() == 3


# --- shape of the plans -----------------------------------------------------


def _clicks(spark):
    return entry._clicks(spark, SF)


def test_no_python_on_hot_paths(spark):
    data = _clicks(spark)
    frames = [
        stats.windowed_stats(data),
        stats.windowed_stats(data, approx=True),
        features.event_features(data),
        features.item_sequences(data),
        profiles.top_products(data),
        recommend.item_similarity(recommend.user_item_ratings(data)),
        errors.error_alerts(errors.classify_errors(entry._error_records(spark, SF))),
    ]
    for df in frames:
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_recency_reaches_the_scan(spark):
    recent, _ = entry._recent(spark, SF, stats.HOUR)
    text = plan(stats.top_items_recent(recent, 0))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in text


def test_point_lookup_reaches_the_scan(spark):
    text = plan(profiles.user_history(_clicks(spark), user=3))
    assert "EqualTo(user_id,3)" in text and "TakeOrderedAndProject" in text


def test_lookup_aggregates_its_table_once(spark):
    data = _clicks(spark)
    counts = data.groupBy("itemid").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(lookup_join(data, counts, "itemid", "n", spread_by=["id"]))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in text


def test_scans_read_needed_columns_only(spark):
    text = plan(profiles.event_distribution(_clicks(spark)))
    assert "ReadSchema: struct<event_type:string>" in text


def test_top_n_is_limited_before_the_shuffle(spark):
    text = plan(profiles.user_history(_clicks(spark)))
    assert "WindowGroupLimit" in text.split("Exchange")[-1]


def test_messages_are_parsed_once(spark):
    valid, _ = parse_events(spark.createDataFrame([("{}",)], "value string"))
    assert plan(valid).count("from_json") == 1


def test_no_cross_join(spark):
    model = recommend.fit(_clicks(spark), 3)
    text = plan(recommend.recommend(model, n=3))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_stream_sources_are_dealt_over_all_tasks(spark):
    """No task gets more of a source as its batches are few."""
    files, at_once = entry._dealt_out(spark.range(1000), 2)
    sizes = files.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 200
    assert at_once == 4  # two batches


def test_scopes_delete_their_own_tables(spark):
    kept = materialize(spark.range(3), "kept")
    with scratch.scope(spark):
        gone = materialize(spark.range(3), "gone")
        path = gone.inputFiles()[0].rsplit("/", 1)[0]
        assert scratch.exists(spark, path)
    assert not scratch.exists(spark, path) and kept.count() == 3


def test_windows_exchange_all_rows_once(spark):
    text = plan(stats.windowed_stats(_clicks(spark)))
    assert text.count("REPARTITION_BY_COL") == 1 and text.count("Exchange hashpartitioning") == 3


def test_checks_scan_the_table_once(spark):
    text = plan(quality.data_quality_report(_clicks(spark)))
    assert text.count("FileScan") == 1
