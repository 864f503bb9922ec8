"""Training data: active users, features, chronological splits and sequences."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktide import schema as S
from clicktide.functions.columns import count_event, event_time, fraction_or_zero
from clicktide.plans.positions import MAX_GROUP_ROWS, largest_group, nth_smallest, with_positions
from clicktide.plans.skew import lookup_join

DAY_MS = 86_400_000


def active_user_events(
    clicks: DataFrame, min_events: int = S.MIN_EVENTS_PER_USER, limit: int | None = None
) -> DataFrame:
    """Events of visitors with at least ``min_events``.

    With ``limit``, the first rows by visitor and time.
    """
    counts = clicks.groupBy("visitorid").agg(F.count(F.lit(1)).alias("_events"))
    active = (
        lookup_join(clicks, counts, "visitorid", "_events", spread_by=["id"])
        .where(F.col("_events") >= min_events)
        .drop("_events")
    )
    return active if limit is None else active.orderBy("visitorid", "timestamp", "id").limit(limit)


def user_features(clicks: DataFrame) -> DataFrame:
    """Per visitor: events, purchases, first and last time, rate and span in days."""
    return (
        clicks.groupBy("visitorid")
        .agg(
            F.count("itemid").alias("total_events"),
            count_event("transaction").alias("purchase_count"),
            F.min("timestamp").alias("first_event_time"),
            F.max("timestamp").alias("last_event_time"),
        )
        .withColumn("conversion_rate", fraction_or_zero("purchase_count", "total_events"))
        .withColumn(
            "activity_days",
            (F.col("last_event_time") - F.col("first_event_time")) / F.lit(1000.0) / F.lit(86400.0),
        )
    )


def item_popularity(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("itemid").agg(F.count(F.lit(1)).alias("item_popularity"))


def event_features(clicks: DataFrame) -> DataFrame:
    """Every event with calendar, type, visitor and item features.

    ``dayofweek`` counts from Monday = 0.  The type columns come from the fixed
    vocabulary, so the schema does not depend on the data.
    """
    dated = clicks.withColumn("datetime", event_time()).select(
        "*",
        F.hour("datetime").alias("hour"),
        F.weekday("datetime").alias("dayofweek"),
        *[
            F.coalesce(F.col("event") == event, F.lit(False)).alias(f"event_{event}")
            for event in S.EVENT_TYPES
        ],
    )
    with_user = lookup_join(
        dated, user_features(clicks), "visitorid", "total_events", spread_by=["id"]
    )
    return lookup_join(
        with_user, item_popularity(clicks), "itemid", "item_popularity", spread_by=["id"]
    )


def save_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the feature table (Parquet, or CSV with a header)."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


# --- splits -----------------------------------------------------------------


def label_by_user(
    clicks: DataFrame,
    test_size: float = S.TEST_SIZE,
    max_group_rows: int = MAX_GROUP_ROWS,
    known_bound: int | None = None,
) -> DataFrame:
    """Add ``is_test``: true for each visitor's newest events.

    At least one event stays in training; single-event visitors have no test part.
    """
    placed = with_positions(clicks, ["visitorid"], ["timestamp", "id"], max_group_rows, known_bound)
    kept = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(1 - test_size)))
    return placed.select(*clicks.columns, (F.col("position") > kept).alias("is_test"))


def split_by_user(
    clicks: DataFrame, test_size: float = S.TEST_SIZE, max_group_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by :func:`label_by_user`.

    Both parts carry the whole plan; to use them several times, write the
    labelled events once and filter that table.
    """
    return parts(label_by_user(clicks, test_size, max_group_rows))


def parts(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        labelled.where(~F.col("is_test")).drop("is_test"),
        labelled.where(F.col("is_test")).drop("is_test"),
    )


def split_by_time(clicks: DataFrame, test_size: float = S.TEST_SIZE) -> tuple[DataFrame, DataFrame]:
    """One cut through all events in (timestamp, id) order, those without a time first.

    The cut is located by counting, so both parts are plain range filters.  Every
    event is in one of them.
    """
    time, known = F.col("timestamp"), F.col("timestamp").isNotNull()
    counted = clicks.agg(F.count(F.lit(1)).alias("rows"), F.count("timestamp").alias("timed")).first()
    rows, untimed = counted["rows"], counted["rows"] - counted["timed"]
    cut = int(rows * (1 - test_size))
    if cut >= rows:
        return clicks, clicks.where(F.lit(False))
    if cut < untimed:
        first_test_id, _ = nth_smallest(clicks.where(~known), "id", cut)
        in_test = known | (F.col("id") >= first_test_id)
    else:
        moment, earlier = nth_smallest(clicks.where(known), "timestamp", cut - untimed)
        at_moment = clicks.where(time == moment)
        first_test_id, _ = nth_smallest(at_moment, "id", cut - untimed - earlier)
        in_test = known & ((time > moment) | ((time == moment) & (F.col("id") >= first_test_id)))
    in_test = F.coalesce(in_test, F.lit(False))
    return clicks.where(~in_test), clicks.where(in_test)


def split_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """Sizes and shares of both parts, their visitors and the visitors in both."""

    def tagged(df, is_test):
        return df.select("visitorid", F.lit(is_test).alias("is_test"))

    test_row = F.col("is_test")
    per_visitor = (
        tagged(train, False).unionByName(tagged(test, True))
        .groupBy("visitorid")
        .agg(F.count_if(~test_row).alias("in_train"), F.count_if(test_row).alias("in_test"))
    )
    trained, tested = F.col("in_train") > 0, F.col("in_test") > 0
    rows = F.col("train_events") + F.col("test_events")
    hundred = F.lit(100.0)
    return per_visitor.agg(
        F.coalesce(F.sum("in_train"), F.lit(0)).alias("train_events"),
        F.coalesce(F.sum("in_test"), F.lit(0)).alias("test_events"),
        F.count_if(trained).alias("train_users"),
        F.count_if(tested).alias("test_users"),
        F.count_if(trained & tested).alias("common_users"),
    ).select(
        "*",
        (hundred * fraction_or_zero("train_events", rows)).alias("train_percent"),
        (hundred * fraction_or_zero("test_events", rows)).alias("test_percent"),
        (hundred * fraction_or_zero("common_users", "test_users")).alias("common_percent"),
    )


# --- sequences --------------------------------------------------------------


def item_sequences(
    clicks: DataFrame, length: int = S.SEQUENCE_LENGTH, max_group_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Sliding windows of ``length`` items per visitor and the item that follows.

    One row per event that has ``length`` events before it: (visitorid,
    position of the target, sequence, target).
    """
    events = clicks.select("visitorid", "timestamp", "id", "itemid")
    if largest_group(events, ["visitorid"]) <= max_group_rows:
        history = Window.partitionBy("visitorid").orderBy("timestamp", "id")
        placed = events.withColumn("position", F.row_number().over(history).cast("long"))
        return _sequences(placed, history, length)

    # A large visitor is cut into blocks of consecutive events.  The last
    # ``length`` events of a block are copied into the next one as context.
    placed = with_positions(events, ["visitorid"], ["timestamp", "id"], known_bound=max_group_rows + 1,
                            max_group_rows=max_group_rows)
    rows = max(max_group_rows, length)
    block = F.expr(f"(position - 1) div {rows}L")
    offset = (F.col("position") - 1) % rows
    tail = (offset >= rows - length) & (F.col("position") < F.col("group_size"))
    blocks = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    copied = placed.withColumn("home", block).withColumn("block", F.explode(blocks))
    history = Window.partitionBy("visitorid", "block").orderBy("position")
    return _sequences(copied, history, length, F.col("block") == F.col("home"))


def _sequences(placed, history, length, keep=None):
    # a NULL item still takes its place in the sequence, hence the struct
    items = F.collect_list(F.struct("itemid")).over(history.rowsBetween(-length, -1))
    rows = placed.withColumn("items", items).where(F.col("position") > length)
    if keep is not None:
        rows = rows.where(keep)
    return rows.select(
        "visitorid", "position", F.col("items.itemid").alias("sequence"), F.col("itemid").alias("target")
    )
