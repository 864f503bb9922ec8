
from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from clicktide import schema as S  # noqa: E402
from clicktide.operators import errors, features, profiles, quality, recommend, stats  # noqa: E402
from clicktide.operators.views import create_views  # noqa: E402
from clicktide.plans import scratch  # noqa: E402
from clicktide.plans.session import configure, state_store_per_core  # noqa: E402
from clicktide.sources import files, messages  # noqa: E402
from clicktide.sources.tables import (  # noqa: E402
    clickstream_from_events,
    clickstream_from_orders,
    newest_in_files,
)
from clicktide.streaming import daily, exact, fanout, panes, pipeline, sinks  # noqa: E402

try:  # the corpus operators may be left out of an installation
    import corpus_pipeline
    from clicktide.llm import queries as corpus
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "clicktide.llm"):
        raise  # they are there, but broken
    corpus = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"


# --- inputs -----------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _clicks(spark, sf_dir, since_ms=None):
    return clickstream_from_events(_table(spark, sf_dir, "events"), since_ms)


def _purchases(spark, sf_dir):
    return clickstream_from_orders(
        _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    )


def _newest_ms(spark, sf_dir):
    return newest_in_files(configure(spark), f"{sf_dir}/events.parquet", "ts")


def _recent(spark, sf_dir, lookback_ms):
    """Clicks not older than the lookback, and the newest event time."""
    as_of = _newest_ms(spark, sf_dir)
    return _clicks(spark, sf_dir, as_of - lookback_ms), as_of


def _recent_windows(spark, sf_dir, lookback_ms):
    # a window that starts inside the lookback holds only clicks inside it
    clicks, as_of = _recent(spark, sf_dir, lookback_ms)
    return stats.windowed_stats(clicks), as_of


def _messages(spark, sf_dir):
    """Clicks as JSON messages; those of ``error`` events arrive cut off."""
    sent = _clicks(spark, sf_dir).select(*pipeline.RAW_COLUMNS)
    encoded = messages.to_messages(sent)
    broken = F.get_json_object("value", "$.event") == "error"
    return encoded.withColumn(
        "value", F.when(broken, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    )


def _error_records(spark, sf_dir):
    """An error message per event, worded by its type, and one per document."""
    kind = F.col("event_type")
    wording = (
        F.when(kind == "view", "JSON parse error")
        .when(kind == "click", "Connection timeout")
        .when(kind == "signup", "read TIMEOUT")
        .when(kind == "purchase", "duplicate key")
        .otherwise("boom")
    )
    of_events = _table(spark, sf_dir, "events").select(
        F.concat_ws(" ", wording, F.lit("at"), "props").alias("error_message"),
        F.col("event_id").alias("batch_id"),
        F.col("props").alias("raw_data"),
    )
    of_documents = _table(spark, sf_dir, "documents").select(
        F.col("text").alias("error_message"),
        F.col("doc_id").alias("batch_id"),
        F.to_json(F.struct("lang", "source")).alias("raw_data"),
    )
    return of_events.unionByName(of_documents)


def _plain(df: DataFrame) -> DataFrame:
    """Column types both engines print alike."""
    plain = {"int": "bigint", "timestamp": "timestamp_ntz", "date": "string"}
    return df.select(
        *[F.col(f.name).cast(plain.get(f.dataType.simpleString(), f.dataType)).alias(f.name)
          for f in df.schema]
    )


# --- statistics -------------------------------------------------------------


def event_summary(spark, sf_dir):
    return stats.event_summary(_clicks(spark, sf_dir))


def total_records(spark, sf_dir):
    return stats.total_records(_clicks(spark, sf_dir))


def windowed_stats(spark, sf_dir):
    return _plain(stats.windowed_stats(_clicks(spark, sf_dir)))


def windowed_stats_sketched(spark, sf_dir):
    return _plain(stats.windowed_stats(_clicks(spark, sf_dir), approx=True))


def event_statistics(spark, sf_dir):
    return _plain(stats.event_statistics(_clicks(spark, sf_dir)))


def approx_distinct_error(spark, sf_dir):
    return stats.approx_distinct_error(_clicks(spark, sf_dir))


def approx_distinct_bound(spark, sf_dir):
    """Orders and parts of all sales: more values than a sketch counts exactly."""
    return stats.approx_distinct_bound(_purchases(spark, sf_dir), "event", ("transactionid", "itemid"))


def realtime_metrics(spark, sf_dir):
    windows, as_of = _recent_windows(spark, sf_dir, stats.HOUR)
    return _plain(stats.realtime_metrics(windows, as_of))


def latest_activity(spark, sf_dir):
    windows, as_of = _recent_windows(spark, sf_dir, 5 * stats.MINUTE)
    return _plain(stats.latest_activity(windows, as_of))


def recent_event_trend(spark, sf_dir):
    windows, as_of = _recent_windows(spark, sf_dir, 30 * stats.MINUTE)
    return stats.recent_event_trend(windows, as_of)


def hourly_activity(spark, sf_dir):
    windows, as_of = _recent_windows(spark, sf_dir, stats.DAY)
    return _plain(stats.hourly_activity(windows, as_of))


def latest_stats(spark, sf_dir):
    return _plain(stats.latest_stats(stats.event_statistics(_clicks(spark, sf_dir))))


def event_share(spark, sf_dir):
    return _plain(stats.event_share(stats.event_statistics(_clicks(spark, sf_dir))))


def views(spark, sf_dir):
    """The summary view joined to the totals view, in SQL."""
    clicks = _clicks(spark, sf_dir)
    create_views(clicks, stats.windowed_stats(clicks), stats.event_statistics(clicks))
    return spark.sql(
        """SELECT s.event, s.event_count, t.total_count, s.unique_items
           FROM event_summary s JOIN latest_stats t ON s.event = t.event"""
    )


def conversion_funnel(spark, sf_dir):
    return stats.conversion_funnel(stats.event_statistics(_clicks(spark, sf_dir)))


def top_items_recent(spark, sf_dir):
    clicks, as_of = _recent(spark, sf_dir, stats.HOUR)
    return stats.top_items_recent(clicks, as_of)


def active_users(spark, sf_dir):
    clicks, as_of = _recent(spark, sf_dir, stats.HOUR)
    return _plain(stats.active_users(clicks, as_of))


def event_timeline(spark, sf_dir):
    clicks, as_of = _recent(spark, sf_dir, stats.HOUR)
    return _plain(stats.event_timeline(clicks, as_of))


def pipeline_health(spark, sf_dir):
    clicks = _clicks(spark, sf_dir)
    return _plain(
        stats.pipeline_health(
            clicks, stats.windowed_stats(clicks), stats.event_statistics(clicks), _newest_ms(spark, sf_dir)
        )
    )


# --- profiles ---------------------------------------------------------------


def user_profile(spark, sf_dir):
    return profiles.user_profile(_clicks(spark, sf_dir))


def user_history(spark, sf_dir):
    return profiles.user_history(_clicks(spark, sf_dir))


def item_stats(spark, sf_dir):
    return profiles.item_stats(_clicks(spark, sf_dir))


def purchase_item_stats(spark, sf_dir):
    return profiles.item_stats(_purchases(spark, sf_dir))


def top_products(spark, sf_dir):
    return profiles.top_products(_clicks(spark, sf_dir))


def ctr_stats(spark, sf_dir):
    return profiles.ctr_stats(_clicks(spark, sf_dir))


def hourly_ctr(spark, sf_dir):
    return profiles.hourly_ctr(_clicks(spark, sf_dir))


def category_distribution(spark, sf_dir):
    return profiles.category_distribution(_clicks(spark, sf_dir))


def popular_items(spark, sf_dir):
    return profiles.popular_items(_clicks(spark, sf_dir))


def dataset_summary(spark, sf_dir):
    return profiles.dataset_summary(_clicks(spark, sf_dir))


def event_distribution(spark, sf_dir):
    return profiles.event_distribution(_clicks(spark, sf_dir))


# --- quality and errors -----------------------------------------------------


def category_distribution_all(spark, sf_dir):
    """Over all sold parts, far more than the usual hundred items."""
    return profiles.category_distribution(_purchases(spark, sf_dir), n_items=None)


def duplicate_events(spark, sf_dir):
    """Duplicates after every transaction has been delivered a second time."""
    clicks = _clicks(spark, sf_dir)
    return quality.duplicate_events(
        clicks.unionByName(clicks.where(F.col("event") == "transaction"))
    )


def invalid_event_types(spark, sf_dir):
    return quality.invalid_event_types(_clicks(spark, sf_dir))


def validate_schema(spark, sf_dir):
    required = {f.name: f.dataType.simpleString() for f in S.CLICKS}
    return quality.validate_schema(_clicks(spark, sf_dir), required)


def constraint_violations(spark, sf_dir):
    """Rules of the click table, transactions delivered a second time."""
    clicks = _clicks(spark, sf_dir)
    return quality.constraint_violations(
        clicks.unionByName(clicks.where(F.col("event") == "transaction")),
        not_null=(*S.REQUIRED_EVENT_COLUMNS, "transactionid"),
        unique=(("id",), quality.DUPLICATE_KEYS),
        max_length={"event": 50},
    )


def data_quality_report(spark, sf_dir):
    return quality.data_quality_report(_clicks(spark, sf_dir))


def classify_errors(spark, sf_dir):
    return errors.classify_errors(_error_records(spark, sf_dir)).select(
        "batch_id", "error_type", "severity"
    )


def error_events(spark, sf_dir):
    return _plain(errors.error_events(_error_records(spark, sf_dir))).select(
        "error_type", "error_message", "severity", "raw_data", "batch_id", "retry_count", "status"
    )


def error_alerts(spark, sf_dir):
    return errors.error_alerts(errors.classify_errors(_error_records(spark, sf_dir)))


def failed_message_count(spark, sf_dir):
    """Messages of ``error`` events, logged as not published and counted."""
    unsent = _messages(spark, sf_dir).where(~F.endswith("value", F.lit("}")))
    path = scratch.new_path(spark, "failed-messages")
    errors.log_failed_messages(errors.failed_messages(unsent, "KafkaTimeoutError", "timed out"), path)
    return errors.failed_message_counts(spark, path).agg(
        F.sum("failed_messages").alias("failed_messages")
    )


def _refuse_thirds(key, value):
    if int(key) % 3 == 0:
        raise TimeoutError(f"no answer for {key}")


def failed_message_log(spark, sf_dir):
    """Messages, some of them cut off, of which those of every third visitor cannot be delivered."""
    path = scratch.new_path(spark, "failed-messages")
    errors.publish(_messages(spark, sf_dir), _refuse_thirds, path)
    return errors.read_failed_messages(spark, path).select(
        "partition_key", "raw_message", F.col("message.itemid").alias("itemid"),
        F.col("error.type").alias("error_type"), F.col("error.message").alias("error_message"),
    )


def handle_errors(spark, sf_dir):
    """Alerts of errors that are stored in the same step."""
    path = scratch.new_path(spark, "errors")
    alerts = errors.handle_errors(_error_records(spark, sf_dir), path)
    stored = spark.read.schema(S.ERROR_EVENTS).parquet(path)
    kept = stored.select(F.col("batch_id").cast("string").alias("batch_id"), F.col("error_message").alias("text"))
    return alerts.join(kept, ["batch_id", "text"], "left_semi")


# --- ingest -----------------------------------------------------------------


def event_messages(spark, sf_dir):
    sent = _clicks(spark, sf_dir).select(*pipeline.RAW_COLUMNS)
    return messages.to_messages(sent)


def parse_events(spark, sf_dir):
    valid, _ = messages.parse_events(_messages(spark, sf_dir))
    return _plain(valid)


def _hostile_messages(spark, sf_dir):
    """Click messages, some of them damaged or odd, by their id."""
    clicks = _clicks(spark, sf_dir)
    encoded = messages.to_messages(clicks.select("id", *pipeline.RAW_COLUMNS)).select(
        F.get_json_object("value", "$.id").cast("long").alias("id"),
        F.regexp_replace("value", r'^\{"id":[0-9]+,', "{").alias("v"),
    )
    kind, v = F.col("id") % 20, F.col("v")
    huge = F.regexp_replace(v, '"timestamp":[0-9]+', '"timestamp":9223372036854775807')

    def transaction(text):
        return F.regexp_replace(v, '"transactionid":[^}]*', f'"transactionid":{text}')

    odd = (
        F.when(kind == 1, huge).when(kind == 2, F.concat(v, F.lit(" garbage"))).when(kind == 3, F.concat(v, v))
        .when(kind == 4, F.concat(v, F.lit("],["), v)).when(kind == 5, F.lit("")).when(kind == 6, transaction('"T-4000"'))
        .when(kind == 7, transaction("4000.7")).when(kind == 8, transaction("4000.0")).otherwise(v)
    )
    return encoded.select(odd.alias("value"))


def parse_hostile_messages(spark, sf_dir):
    """Every message is either valid or kept whole as invalid."""
    valid, invalid = messages.parse_events(_hostile_messages(spark, sf_dir))
    fields = ("timestamp", "visitorid", "event", "itemid", "transactionid")
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fields])
    return valid.select(F.lit("valid").alias("outcome"), told.alias("content")).unionByName(
        invalid.select(F.lit("invalid").alias("outcome"), F.col("raw_message").alias("content"))
    )


def read_events_csv(spark, sf_dir):
    """Events written as CSV with the columns turned round, and read again."""
    path = scratch.new_path(spark, "events-csv")
    clicks = _clicks(spark, sf_dir).withColumn("transactionid", F.col("transactionid").cast("double"))
    clicks.select(*reversed(S.EVENTS_CSV.names)).write.option("header", True).csv(path)
    return files.read_events_csv(spark, path)


def nan_to_null(spark, sf_dir):
    """Readings of ``error`` events are not numbers."""
    readings = _table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )
    return messages.nan_to_null(readings)


def failed_batch_records(spark, sf_dir):
    batch = _clicks(spark, sf_dir).select(*pipeline.RAW_COLUMNS)
    return messages.as_json(messages.failed_batch(batch, 7, "connection refused").drop("error_timestamp"))


def load_category_tree(spark, sf_dir):
    """Regions and nations as a two-level tree, through CSV."""
    regions = _table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("categoryid"), F.lit(None).cast("int").alias("parentid")
    )
    nations = _table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).alias("categoryid"), F.col("n_regionkey").alias("parentid")
    )
    csv, target = scratch.new_path(spark, "category-csv"), scratch.new_path(spark, "category-tree")
    tree = regions.unionByName(nations).select("parentid", "categoryid")  # order of the header counts
    tree.write.option("header", True).csv(csv)
    files.load_category_tree(spark, csv, target)
    return _plain(spark.read.parquet(target))


def load_item_properties(spark, sf_dir):
    """Attributes of parts as (item, property, value), through two CSV parts."""
    part = _table(spark, sf_dir, "part")
    paths = [scratch.new_path(spark, f"properties-{i}") for i in (1, 2, 3)]
    for path, columns in zip(paths, (("p_name", "p_brand", "p_type"), ("p_size", "p_retailprice"))):
        unpivoted = part.select(
            F.lit(None).cast("long").alias("timestamp"),
            F.col("p_partkey").alias("itemid"),
            F.inline(
                F.array(
                    *[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value"))
                      for c in columns]
                )
            ),
        )
        unpivoted.write.option("header", True).csv(path)
    target = scratch.new_path(spark, "item-properties")
    files.load_item_properties(spark, paths, target)  # the third part does not exist
    return spark.read.parquet(target).select("itemid", "property", "value")


# --- features ---------------------------------------------------------------


def active_user_events(spark, sf_dir):
    return features.active_user_events(_clicks(spark, sf_dir))


def active_buyer_events(spark, sf_dir):
    """Order lines of customers with at least 40 of them."""
    return features.active_user_events(_purchases(spark, sf_dir), min_events=40)


def user_features(spark, sf_dir):
    return features.user_features(_clicks(spark, sf_dir))


def item_popularity(spark, sf_dir):
    return features.item_popularity(_clicks(spark, sf_dir))


def event_features(spark, sf_dir):
    return _plain(features.event_features(_clicks(spark, sf_dir)))


def saved_event_features(spark, sf_dir):
    """Features written as a table and read again."""
    path = scratch.new_path(spark, "features")
    features.save_features(features.event_features(_clicks(spark, sf_dir)), path)
    return _plain(spark.read.parquet(path))


def train_split(spark, sf_dir):
    return features.split_by_user(_clicks(spark, sf_dir))[0]


def test_split(spark, sf_dir):
    return features.split_by_user(_clicks(spark, sf_dir))[1]


def train_split_by_range(spark, sf_dir):
    """The same by the plan for visitors that are too large for one task."""
    return features.split_by_user(_clicks(spark, sf_dir), max_group_rows=10)[0]


def time_split(spark, sf_dir):
    train, test = features.split_by_time(_clicks(spark, sf_dir))
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


def split_summary(spark, sf_dir):
    return features.split_summary(*features.split_by_time(_clicks(spark, sf_dir)))


def _printed(sequences):
    return sequences.withColumn(
        "sequence", F.array_join(F.transform("sequence", lambda i: i.cast("string")), ",")
    )


def item_sequences(spark, sf_dir):
    return _printed(features.item_sequences(_clicks(spark, sf_dir)))


def item_sequences_by_range(spark, sf_dir):
    """The same by the plan for visitors that are too large for one task."""
    return _printed(features.item_sequences(_clicks(spark, sf_dir), max_group_rows=20))


# --- recommendations --------------------------------------------------------


def user_item_ratings(spark, sf_dir):
    return recommend.user_item_ratings(_clicks(spark, sf_dir))


def item_similarity(spark, sf_dir):
    return recommend.item_similarity(recommend.user_item_ratings(_clicks(spark, sf_dir)))


def item_similarity_blocked(spark, sf_dir):
    """The same with every visitor multiplied in blocks."""
    ratings = recommend.user_item_ratings(_clicks(spark, sf_dir))
    return recommend.item_similarity(ratings, paired_items=0)


def item_neighbours(spark, sf_dir):
    ratings = recommend.user_item_ratings(_clicks(spark, sf_dir))
    return recommend.item_neighbours(ratings)


def purchase_item_neighbours(spark, sf_dir):
    ratings = recommend.user_item_ratings(_purchases(spark, sf_dir))
    return recommend.item_neighbours(ratings)


def recommend_users(spark, sf_dir):
    return recommend.recommend(recommend.fit(_clicks(spark, sf_dir)))


def recommend_buyers(spark, sf_dir):
    return recommend.recommend(recommend.fit(_purchases(spark, sf_dir)))


def recommend_cold_users(spark, sf_dir):
    """Customers that have no clicks."""
    model = recommend.fit(_clicks(spark, sf_dir))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("visitorid"))
    cold = customers.join(model.visitors, "visitorid", "left_anti")
    return recommend.recommend(model, cold)


def recommend_more(spark, sf_dir):
    """Longer lists than the model stores neighbours for, from a model that was saved and loaded."""
    path = scratch.new_path(spark, "model")
    recommend.save(recommend.fit(_clicks(spark, sf_dir)), path)
    return recommend.recommend(recommend.load(spark, path), n=15)


def _refitted(clicks, days):
    """A model of all clicks but those of the last days, refitted with these."""
    newest = clicks.agg(F.max("timestamp")).first()[0]
    fresh = F.col("timestamp") > (newest or 0) - days * 86_400_000
    return recommend.refit(recommend.fit(clicks.where(~fresh)), clicks.where(fresh))


def refit_neighbours(spark, sf_dir):
    """Neighbours from a model that got the newest day later than the others."""
    return _refitted(_clicks(spark, sf_dir), 1).neighbours


def refit_recommend_buyers(spark, sf_dir):
    """Recommendations after the orders of the newest week were added to a model."""
    return recommend.recommend(_refitted(_purchases(spark, sf_dir), 7))


def recommend_untrained(spark, sf_dir):
    """Customers before any model exists."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("visitorid"))
    return recommend.recommend(None, customers, clicks=_clicks(spark, sf_dir))


def hit_rate(spark, sf_dir):
    return recommend.train(_clicks(spark, sf_dir))[1]


# --- streaming --------------------------------------------------------------


def _event_stream(spark, sf_dir):
    table = _table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return _with_time(clickstream_from_events(stream))


def _with_time(clicks):
    return clicks.withColumn("event_time", F.timestamp_millis("timestamp"))


def _message_stream(spark, sf_dir):
    path = scratch.new_path(spark, "messages")
    _messages(spark, sf_dir).select("value").write.text(path)
    return messages.read_stream(spark, "files", path=path)


def _dealt_out(rows, batches):
    """Rows in as many files as the session shuffles into, and how many files make one of so many batches."""
    files = max(batches, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(files), -(-files // batches)


def _finish(query):
    query.awaitTermination()


def stream_raw_events(spark, sf_dir):
    valid, _ = messages.parse_events(_message_stream(spark, sf_dir))
    target, checkpoint = scratch.new_path(spark, "raw"), scratch.new_path(spark, "raw-cp")
    _finish(pipeline.stream_raw_events(valid, target, checkpoint, pipeline.ALL_AVAILABLE))
    return _plain(spark.read.parquet(target))


def dead_letter_events(spark, sf_dir):
    _, invalid = messages.parse_events(_message_stream(spark, sf_dir))
    target, checkpoint = scratch.new_path(spark, "dead"), scratch.new_path(spark, "dead-cp")
    _finish(pipeline.stream_dead_letters(invalid, target, checkpoint, pipeline.ALL_AVAILABLE))
    return spark.read.schema("raw_message string, error_message string").json(target)


def stream_windowed_stats(spark, sf_dir):
    target, checkpoint = scratch.new_path(spark, "windows"), scratch.new_path(spark, "windows-cp")
    write = sinks.upsert_batches(target, "created_at")
    stream = _event_stream(spark, sf_dir)
    with state_store_per_core(spark):
        _finish(pipeline.stream_windowed_stats(stream, write, checkpoint, pipeline.ALL_AVAILABLE))
    return _plain(sinks.read_upserts(spark, target, pipeline.WINDOW_KEYS).drop("created_at"))


def stream_event_statistics(spark, sf_dir):
    target, checkpoint = scratch.new_path(spark, "totals"), scratch.new_path(spark, "totals-cp")
    write = sinks.upsert_batches(target, "updated_at")
    stream = _event_stream(spark, sf_dir)
    with state_store_per_core(spark):
        _finish(pipeline.stream_event_statistics(stream, write, checkpoint, pipeline.ALL_AVAILABLE))
    return sinks.read_upserts(spark, target, pipeline.TOTAL_KEYS).drop("updated_at")


def stream_late_data(spark, sf_dir):
    """All events, then the newest again, then all transactions again.

    The second part moves the watermark on, so the repeated transactions count
    only in windows that are still open.
    """
    clicks = _clicks(spark, sf_dir)
    newest = clicks.orderBy(F.desc("timestamp"), F.desc("id")).limit(1)
    late = clicks.where(F.col("event") == "transaction")
    source, target, checkpoint = (scratch.new_path(spark, f"late-{p}") for p in ("in", "out", "cp"))
    write = sinks.upsert_batches(target, "created_at")
    for part in (clicks, newest, late):
        part.write.mode("append").parquet(source)
        stream = _with_time(spark.readStream.schema(clicks.schema).parquet(source))
        with state_store_per_core(spark):
            _finish(pipeline.stream_windowed_stats(stream, write, checkpoint, pipeline.ALL_AVAILABLE))
    return _plain(sinks.read_upserts(spark, target, pipeline.WINDOW_KEYS).drop("created_at"))


def upsert_windowed_stats(spark, sf_dir):
    """A second batch with transactions counted twice, then that batch replayed."""
    clicks = _clicks(spark, sf_dir)
    sold = clicks.where(F.col("event") == "transaction")
    target = scratch.new_path(spark, "upserts")
    write = sinks.upsert_batches(target, "created_at")
    write(stats.windowed_stats(clicks), 0)
    for _ in range(2):
        write(stats.windowed_stats(sold.unionByName(sold)), 1)
    return _plain(sinks.read_upserts(spark, target, pipeline.WINDOW_KEYS).drop("created_at"))


def upsert_event_statistics(spark, sf_dir):
    """The same for the totals, with the state folded between the batches."""
    clicks = _clicks(spark, sf_dir)
    sold = clicks.where(F.col("event") == "transaction")
    target = scratch.new_path(spark, "upserts")
    write = sinks.upsert_batches(target, "updated_at")
    write(stats.event_statistics(clicks), 0)
    sinks.compact_upserts(spark, target, pipeline.TOTAL_KEYS)
    for _ in range(2):
        write(stats.event_statistics(sold.unionByName(sold)), 1)
    return sinks.read_upserts(spark, target, pipeline.TOTAL_KEYS).drop("updated_at")


def upsert_incomplete_batch(spark, sf_dir):
    """A batch that was never finished lies between two complete ones."""
    clicks = _clicks(spark, sf_dir)
    sold = clicks.where(F.col("event") == "transaction")
    target = scratch.new_path(spark, "upserts")
    write = sinks.upsert_batches(target, "updated_at")
    write(stats.event_statistics(clicks), 0)
    unfinished = stats.event_statistics(clicks.unionByName(clicks)).withColumn("updated_at", F.current_timestamp())
    unmarked = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    unfinished.write.option(unmarked, "false").parquet(f"{target}/changes/batch_id=1")
    write(stats.event_statistics(sold.unionByName(sold)), 2)
    return sinks.read_upserts(spark, target, pipeline.TOTAL_KEYS).drop("updated_at")


def failed_sink_batches(spark, sf_dir):
    """Events of a sink that refuses every batch, with the alert that raises."""

    def refuse(batch, batch_id):
        raise ConnectionError("connection refused")

    root, checkpoint = scratch.new_path(spark, "refused"), scratch.new_path(spark, "refused-cp")
    valid, _ = messages.parse_events(_message_stream(spark, sf_dir))
    write = sinks.guarded(refuse, pipeline.failure_store(root, "clicks"))
    _finish(pipeline.stream_clicks(valid, write, checkpoint, pipeline.ALL_AVAILABLE))
    alert = spark.read.parquet(f"{root}/error_alerts").select(F.col("batch_id").cast("long"), "color", "text")
    kept = spark.read.schema(
        "timestamp long, visitorid long, event string, itemid long, transactionid string, error_message string, "
        "batch_id long"
    ).json(f"{root}/failed_batches")
    return kept.join(alert, "batch_id").drop("batch_id", "table")


def consume_events(spark, sf_dir):
    """The storing consumer, a file of messages at a time; what it stores and what it rejects."""
    source, root, checkpoint = (scratch.new_path(spark, f"consume-{p}") for p in ("in", "out", "cp"))
    hostile = _hostile_messages(spark, sf_dir)
    hostile.repartition(4).write.text(source)
    stream = messages.read_stream(spark, "files", path=source, maxFilesPerTrigger=1)
    _finish(pipeline.consume(stream, root, checkpoint, pipeline.ALL_AVAILABLE))
    stored = spark.read.parquet(f"{root}/clickstream_events").select(
        *pipeline.RAW_COLUMNS, F.lit(False).alias("rejected")
    )
    rejected = spark.read.schema(
        "timestamp long, visitorid long, event string, itemid long, transactionid string"
    ).json(f"{root}/rejected_events").drop("batch_id")
    return stored.withColumn("transactionid", F.col("transactionid").cast("string")).unionByName(
        rejected.withColumn("rejected", F.lit(True))
    )


def pipeline_restarted(spark, sf_dir):
    """Raw events of the whole pipeline, stopped after some messages and started again with the rest."""
    source, root, checkpoint = (scratch.new_path(spark, f"pipeline-{p}") for p in ("in", "out", "cp"))
    sent = _messages(spark, sf_dir).select("value").withColumn("late", F.get_json_object("value", "$.itemid") > 50)
    for late in (False, True):
        part = sent.where(F.coalesce("late", F.lit(False)) == late).select("value")
        part.coalesce(3).write.mode("append").text(source)
        stream = messages.read_stream(spark, "files", path=source, maxFilesPerTrigger=2)
        with state_store_per_core(spark):
            pipeline.await_all(spark, pipeline.start_pipeline(stream, root, checkpoint, pipeline.ALL_AVAILABLE))
    raw = spark.read.parquet(f"{root}/live_clickstream_events").select(*pipeline.RAW_COLUMNS, "event_date")
    return _plain(raw)


def stream_pane_windows(spark, sf_dir):
    """Sliding windows from panes that a stream keeps by day."""
    target, checkpoint = scratch.new_path(spark, "panes"), scratch.new_path(spark, "panes-cp")
    stored = panes.pane_table(spark, target)
    counted = panes.pane_counts(_event_stream(spark, sf_dir))
    with state_store_per_core(spark):
        writer = counted.writeStream.outputMode("update").foreachBatch(stored.sink())
        _finish(writer.option("checkpointLocation", checkpoint).trigger(**pipeline.ALL_AVAILABLE).start())
    return _plain(panes.read_windows(stored))


def upsert_daily_windows(spark, sf_dir):
    """Windows upserted by day: transactions counted twice in the second batch, which is replayed, then folded."""
    clicks = _clicks(spark, sf_dir)
    sold = clicks.where(F.col("event") == "transaction")
    target = scratch.new_path(spark, "daily")
    stored = daily.DailyTable(spark, target, F.col("window_start"), pipeline.WINDOW_KEYS)
    stored.write(stats.windowed_stats(clicks), 0)
    for _ in range(2):
        stored.write(stats.windowed_stats(sold.unionByName(sold)), 1)
    stored.fold(least=1)
    return _plain(stored.read())


def stream_exact_statistics(spark, sf_dir):
    """Exact statistics of a stream of purchases, stopped after a part of the orders and started again."""
    source, target, checkpoint = (scratch.new_path(spark, f"exact-{p}") for p in ("in", "out", "cp"))
    bought = _purchases(spark, sf_dir).select("transactionid", "visitorid", "event", "itemid")
    for late in (False, True):
        part = bought.where((F.col("transactionid") % 3 == 0) == F.lit(late))
        files, at_once = _dealt_out(part, 2)
        files.write.mode("append").parquet(source)
        stream = spark.readStream.schema(bought.schema).option("maxFilesPerTrigger", at_once).parquet(source)
        with state_store_per_core(spark):
            _finish(exact.stream_exact_statistics(stream, target, checkpoint, pipeline.ALL_AVAILABLE))
    return exact.read_exact(spark, target).drop("updated_at")


def _fanned_out(spark, sent):
    source, root, checkpoint = (scratch.new_path(spark, f"fan-{p}") for p in ("in", "out", "cp"))
    sent.repartition(3).write.text(source)
    stream = messages.read_stream(spark, "files", path=source, maxFilesPerTrigger=1)
    _finish(fanout.start_fan_out(stream, root, checkpoint, pipeline.ALL_AVAILABLE))
    return fanout.ClickTables(spark, root)


def fan_out_events(spark, sf_dir):
    """The raw table of the one-query pipeline."""
    return _plain(_fanned_out(spark, _messages(spark, sf_dir).select("value")).live.read())


def fan_out_totals(spark, sf_dir):
    """The totals of the one-query pipeline over messages some of which are damaged."""
    return _fanned_out(spark, _hostile_messages(spark, sf_dir)).read_totals()


def stream_health(spark, sf_dir):
    """What the one-query pipeline took in and refused."""
    told = _fanned_out(spark, _hostile_messages(spark, sf_dir)).read_health()
    return told.agg(*[F.sum(c).alias(c) for c in ("messages", "valid", "invalid")])


# --- contract ---------------------------------------------------------------

_QUERIES = (
    event_summary, total_records, windowed_stats, windowed_stats_sketched, event_statistics,
    approx_distinct_error, realtime_metrics, latest_activity, recent_event_trend, hourly_activity,
    latest_stats, event_share, views, conversion_funnel, top_items_recent, active_users, event_timeline,
    pipeline_health,
    user_profile, user_history, item_stats, purchase_item_stats, top_products, ctr_stats, hourly_ctr,
    category_distribution, popular_items, dataset_summary, event_distribution,
    duplicate_events, invalid_event_types, validate_schema, constraint_violations,
    data_quality_report, classify_errors, error_events, error_alerts, failed_message_count,
    event_messages, parse_events, nan_to_null, failed_batch_records, load_category_tree,
    load_item_properties,
    active_user_events, active_buyer_events, user_features, item_popularity, event_features,
    train_split, train_split_by_range, test_split, time_split, split_summary, item_sequences,
    item_sequences_by_range,
    user_item_ratings, item_similarity, item_similarity_blocked, item_neighbours,
    purchase_item_neighbours, recommend_users, recommend_buyers, recommend_cold_users,
    recommend_untrained, hit_rate, refit_neighbours, refit_recommend_buyers,
    stream_raw_events, dead_letter_events, stream_windowed_stats, stream_event_statistics,
    stream_late_data, upsert_windowed_stats, upsert_event_statistics,
    approx_distinct_bound, category_distribution_all, failed_message_log, handle_errors,
    parse_hostile_messages, read_events_csv, saved_event_features, recommend_more,
    upsert_incomplete_batch, failed_sink_batches, consume_events, pipeline_restarted,
    stream_pane_windows, upsert_daily_windows, stream_exact_statistics, fan_out_events, fan_out_totals, stream_health,
)


def entry(spark: SparkSession) -> DataFrame:
    return windowed_stats(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {query.__name__: query for query in _QUERIES}
    if corpus:
        named |= corpus.QUERIES | {"pipeline": corpus_pipeline.run}
    return named


def oracle_sql() -> dict[str, str]:
    named = oracle_queries.all_queries()
    if corpus:
        named |= corpus.ORACLES
        if corpus_pipeline.ORACLE_SQL:
            named["pipeline"] = corpus_pipeline.ORACLE_SQL
    return named
