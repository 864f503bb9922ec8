"""Per-user, per-item and overall reports on the click table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktide import schema as S
from clicktide.functions.columns import (
    category_name,
    count_event,
    event_second,
    fraction_or_zero,
    percent_or_zero,
    stage_counts,
)


def _total(name):
    return F.count(F.lit(1)).alias(name)


def user_profile(clicks: DataFrame, user: int | None = None) -> DataFrame:
    """Totals per visitor, or for one; an unknown visitor gives no row."""
    rows = clicks if user is None else clicks.where(F.col("visitorid") == user)
    return rows.groupBy("visitorid").agg(
        _total("total_events"),
        count_event("addtocart").alias("cart_events"),
        count_event("transaction").alias("purchase_events"),
    )


def user_history(clicks: DataFrame, user: int | None = None, n: int = 20) -> DataFrame:
    """Newest ``n`` events per visitor, or of one.

    The rank filter is applied before the shuffle as well, so a visitor sends
    at most ``n`` rows per task.
    """
    stamp = F.when(F.col("timestamp") != 0, F.col("timestamp").cast("string"))
    columns = ["visitorid", stamp.alias("timestamp"), "event", "itemid", "transactionid"]
    newest = [F.desc("timestamp"), F.desc("id")]
    if user is not None:
        return clicks.where(F.col("visitorid") == user).orderBy(*newest).limit(n).select(*columns)
    rank = F.row_number().over(Window.partitionBy("visitorid").orderBy(*newest))
    return clicks.withColumn("recency", rank).where(F.col("recency") <= n).select(
        *columns, F.col("recency").cast("long").alias("recency")
    )


def item_stats(clicks: DataFrame, item: int | None = None) -> DataFrame:
    """Totals per item, or for one; purchases over all events as a fraction."""
    rows = clicks if item is None else clicks.where(F.col("itemid") == item)
    return (
        rows.groupBy("itemid")
        .agg(
            _total("total_events"),
            F.count_distinct("visitorid").alias("unique_visitors"),
            *stage_counts(),
        )
        .withColumn("conversion_rate", fraction_or_zero("purchases", "total_events"))
    )


def top_products(clicks: DataFrame, n: int = 10) -> DataFrame:
    """The most clicked items, ranked."""
    top = (
        clicks.groupBy("itemid")
        .agg(
            _total("total_clicks"),
            F.count_distinct("visitorid").alias("unique_visitors"),
            *stage_counts(),
        )
        .orderBy(F.desc("total_clicks"), "itemid")
        .limit(n)
    )
    # n rows are left, so one task may number them
    rank = F.row_number().over(Window.orderBy(F.desc("total_clicks"), "itemid")).cast("long")
    return top.select(
        rank.alias("rank"),
        F.col("itemid").alias("item_id"),
        "total_clicks",
        "unique_visitors",
        "views",
        "addtocarts",
        "purchases",
        percent_or_zero("purchases", "total_clicks").alias("ctr"),
    )


def ctr_stats(clicks: DataFrame) -> DataFrame:
    """Overall stage totals and rates; a rate over zero is 0."""
    return clicks.agg(_total("total_events"), *stage_counts()).select(
        "*",
        percent_or_zero("addtocarts", "views").alias("view_to_cart_rate"),
        percent_or_zero("purchases", "addtocarts").alias("cart_to_purchase_rate"),
        percent_or_zero("purchases", "views").alias("overall_conversion_rate"),
    )


def hourly_ctr(clicks: DataFrame) -> DataFrame:
    """Stage totals and purchase rate per hour of the day."""
    hour = F.format_string("%02d:00", F.coalesce(F.hour(event_second()), F.lit(0)))
    return (
        clicks.groupBy(hour.alias("hour"))
        .agg(_total("total_events"), *stage_counts())
        .withColumn("ctr", percent_or_zero("purchases", "views"))
        .orderBy("hour")
    )


def category_distribution(
    clicks: DataFrame, n_items: int | None = 100, names: tuple[str, ...] = S.CATEGORY_NAMES
) -> DataFrame:
    """Click share per virtual category over the ``n_items`` top items, or all (None)."""
    per_category = (
        popular_items(clicks, n_items)
        .groupBy(category_name("itemid", names).alias("category"))
        .agg(F.sum("clicks").alias("clicks"))
    )
    # at most one row per category name
    everything = F.sum("clicks").over(Window.partitionBy())
    return per_category.withColumn("percentage", percent_or_zero("clicks", everything)).orderBy(
        F.desc("clicks"), "category"
    )


def popular_items(clicks: DataFrame, n: int | None = S.TOP_N) -> DataFrame:
    counts = clicks.groupBy("itemid").agg(_total("clicks"))
    if n is None:
        return counts
    return (
        counts.orderBy(F.desc("clicks"), "itemid")
        .limit(n)
    )


def dataset_summary(clicks: DataFrame) -> DataFrame:
    return clicks.agg(
        _total("records"),
        F.count_distinct("visitorid").alias("users"),
        F.count_distinct("itemid").alias("items"),
    ).withColumn("avg_events_per_user", fraction_or_zero("records", "users"))


def event_distribution(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("event").agg(_total("events")).orderBy(F.desc("events"), "event")
