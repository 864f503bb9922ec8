"""Windowed and cumulative statistics, and the reports built on them.

``clicks`` is the click table (id, timestamp in ms, visitorid, event, itemid,
transactionid).  ``windows`` is the result of :func:`windowed_stats`, ``totals``
that of :func:`event_statistics`.  ``as_of`` (epoch ms) stands for "now".
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktide import schema as S
from clicktide.functions.columns import (
    event_second,
    event_time,
    percent,
    stage_counts,
)

MINUTE = 60_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Sketches up to this size count exactly (2**12 distinct values), beyond it
# with a relative error of about 1.6 %.
SKETCH_LG = 12


def approx_distinct(column: str, lg: int = SKETCH_LG):
    """Distinct count in bounded memory, usable in streams."""
    return F.theta_sketch_estimate(F.theta_sketch_agg(column, lg))


# --- base tables ------------------------------------------------------------


def event_summary(clicks: DataFrame) -> DataFrame:
    """Per event: rows, exact distinct visitors and items."""
    return clicks.groupBy("event").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("visitorid").alias("unique_visitors"),
        F.count_distinct("itemid").alias("unique_items"),
    )


def total_records(clicks: DataFrame) -> DataFrame:
    return clicks.agg(F.count(F.lit(1)).alias("total_records"))


def event_statistics(clicks: DataFrame, approx: bool = False) -> DataFrame:
    """Cumulative statistics per event; ``updated_at`` is its newest event time."""
    distinct = approx_distinct if approx else F.count_distinct
    return clicks.groupBy("event").agg(
        F.count(F.lit(1)).alias("total_count"),
        distinct("visitorid").alias("unique_visitors"),
        distinct("itemid").alias("unique_items"),
        F.max(event_time()).alias("updated_at"),
    )


def windowed_stats(
    clicks: DataFrame,
    size_ms: int = S.WINDOW_SIZE_MS,
    slide_ms: int = S.WINDOW_SLIDE_MS,
    approx: bool = False,
) -> DataFrame:
    """Per sliding window and event: rows, distinct users, distinct items."""
    if size_ms % slide_ms:
        raise ValueError("the window size must be a multiple of the slide")
    build = _windows_by_sketch if approx else _windows_exact
    counted = build(clicks.where(F.col("timestamp").isNotNull()), size_ms // slide_ms, slide_ms)
    start = F.col("start") * slide_ms
    return counted.select(
        F.timestamp_millis(start).alias("window_start"),
        F.timestamp_millis(start + size_ms).alias("window_end"),
        "event",
        "event_count",
        "unique_users",
        "unique_items",
    )


def _pane(slide_ms):
    # a pane is one slide long; a window covers the panes start .. start + k - 1
    return F.expr(f"(timestamp - pmod(timestamp, {slide_ms}L)) div {slide_ms}L").alias("pane")


def _starts(k):
    return F.explode(F.sequence(F.col("pane") - (k - 1), F.col("pane"))).alias("start")


PANES_PER_BLOCK = 64


def _windows_exact(clicks, k, slide_ms, block_panes=PANES_PER_BLOCK):
    # All rows are exchanged once, by (event, visitor or item, block of panes);
    # the counts per pane and the gaps between panes both come from that.  A
    # block's first panes also look back at the last panes of the block before,
    # which are copied into it.  A visitor already covers the windows of its
    # previous pane, so it is new only in the last ``width`` of the k windows that
    # contain the pane.  With panes counted by width, distinct counts become sums
    # over few rows.
    sides = F.explode(
        F.array(
            F.struct(F.lit(True).alias("user"), F.col("visitorid").alias("who")),
            F.struct(F.lit(False).alias("user"), F.col("itemid").alias("who")),
        )
    ).alias("s")
    size = max(block_panes, k)
    offset = F.pmod(F.col("pane"), F.lit(size).cast("long"))
    home = F.expr("pane - offset")
    blocks = F.when(F.col("offset") > size - k, F.array(home, home + size)).otherwise(F.array(home))
    panes = (
        clicks.select("event", _pane(slide_ms), sides)
        .withColumn("offset", offset)
        .select("event", "s.user", "s.who", "pane", F.explode(blocks).alias("block"))
        .repartition("event", "user", "who", "block")
        .groupBy("event", "user", "who", "block", "pane")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    before = F.lag("pane").over(Window.partitionBy("event", "user", "who", "block").orderBy("pane"))
    width = F.least(F.lit(k), F.coalesce(F.col("pane") - before, F.lit(k)))
    counted = (
        panes.withColumn("width", width)
        .where(F.col("pane") >= F.col("block"))  # not the copies
        .groupBy("event", "user", "pane", "width")
        .agg(F.sum("n").alias("n"), F.count("who").alias("who"))
    )
    user, fresh = F.col("user"), F.col("start") > F.col("pane") - F.col("width")

    def total(column, keep):
        return F.coalesce(F.sum(F.when(keep, F.col(column))), F.lit(0))

    return (
        counted.select("event", "user", "pane", "width", "n", "who", _starts(k))
        .groupBy("start", "event")
        .agg(
            total("n", user).alias("event_count"),
            total("who", user & fresh).alias("unique_users"),
            total("who", ~user & fresh).alias("unique_items"),
        )
    )


def _windows_by_sketch(clicks, k, slide_ms):
    # one small sketch per pane crosses the shuffle, not the rows
    panes = (
        clicks.select("event", _pane(slide_ms), "visitorid", "itemid")
        .groupBy("event", "pane")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.theta_sketch_agg("visitorid", SKETCH_LG).alias("users"),
            F.theta_sketch_agg("itemid", SKETCH_LG).alias("items"),
        )
    )
    return (
        panes.select("event", "n", "users", "items", _starts(k))
        .groupBy("start", "event")
        .agg(
            F.sum("n").alias("event_count"),
            F.theta_sketch_estimate(F.theta_union_agg("users", SKETCH_LG)).alias("unique_users"),
            F.theta_sketch_estimate(F.theta_union_agg("items", SKETCH_LG)).alias("unique_items"),
        )
    )


def approx_distinct_error(clicks: DataFrame, rsd: float = 0.05) -> DataFrame:
    """Approximate against exact distinct counts per event.

    Says whether the estimate is within three standard errors.
    """
    counts = clicks.groupBy("event").agg(
        F.count_distinct("visitorid").alias("exact_visitors"),
        F.count_distinct("itemid").alias("exact_items"),
    )
    estimates = clicks.groupBy("event").agg(
        F.approx_count_distinct("visitorid", rsd).alias("visitors"),
        F.approx_count_distinct("itemid", rsd).alias("items"),
    )

    def within(estimate, exact):
        return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(
            F.lit(1.0), 3 * rsd * F.col(exact)
        )

    return counts.join(estimates, "event").select(
        "event",
        "exact_visitors",
        "exact_items",
        within("visitors", "exact_visitors").alias("visitors_within_bound"),
        within("items", "exact_items").alias("items_within_bound"),
    )


def approx_distinct_bound(
    df: DataFrame, group: str, columns: tuple[str, ...], lg: int = SKETCH_LG
) -> DataFrame:
    """``(group, counted, exact, within_bound)``: the sketches the streams use against exact counts.

    Within the bound means exact up to ``2**lg`` values, and beyond within four
    standard errors of ``1 / sqrt(2**lg)``.
    """
    counted = df.groupBy(group).agg(
        *[F.count_distinct(c).alias(f"exact_{c}") for c in columns],
        *[approx_distinct(c, lg).alias(f"estimate_{c}") for c in columns],
    )

    def row(c):
        exact, estimate = F.col(f"exact_{c}"), F.col(f"estimate_{c}")
        slack = F.when(exact <= 2**lg, F.lit(0.0)).otherwise(4.0 / 2 ** (lg / 2) * exact)
        return F.struct(
            F.lit(c).alias("counted"), exact.alias("exact"), (F.abs(estimate - exact) <= slack).alias("within_bound")
        )

    return counted.select(group, F.inline(F.array(*[row(c) for c in columns])))


# --- reports over the statistics tables -------------------------------------


def since(column: str, as_of: int, lookback_ms: int):
    """Instants not older than ``lookback_ms`` before ``as_of``."""
    return F.col(column) >= F.timestamp_millis(F.lit(as_of - lookback_ms))


def realtime_metrics(windows: DataFrame, as_of: int, lookback_ms: int = HOUR) -> DataFrame:
    """Windows of the last hour, newest first."""
    return windows.where(since("window_start", as_of, lookback_ms)).orderBy(
        F.desc("window_start"), "event"
    )


def latest_activity(windows: DataFrame, as_of: int, lookback_ms: int = 5 * MINUTE) -> DataFrame:
    """Windows of the last five minutes, newest and busiest first."""
    return windows.where(since("window_start", as_of, lookback_ms)).orderBy(
        F.desc("window_start"), F.desc("event_count"), "event"
    )


def recent_event_trend(
    windows: DataFrame, as_of: int, lookback_ms: int = 30 * MINUTE
) -> DataFrame:
    """Per event over the recent windows.

    The windows overlap, so sums over windows count an event once per window.
    """
    return (
        windows.where(since("window_start", as_of, lookback_ms))
        .groupBy("event")
        .agg(
            F.count(F.lit(1)).alias("window_count"),
            F.sum("event_count").alias("total_events"),
            F.avg("event_count").alias("avg_events_per_window"),
            F.sum("unique_users").alias("total_unique_users"),
            F.avg("unique_users").alias("avg_users_per_window"),
        )
        .orderBy(F.desc("total_events"), "event")
    )


def hourly_activity(windows: DataFrame, as_of: int, lookback_ms: int = DAY) -> DataFrame:
    """Sums per hour and event over the windows of the last day."""
    return (
        windows.where(since("window_start", as_of, lookback_ms))
        .groupBy(F.date_trunc("hour", "window_start").alias("hour"), "event")
        .agg(
            F.sum("event_count").alias("total_count"),
            F.sum("unique_users").alias("total_users"),
            F.sum("unique_items").alias("total_items"),
        )
        .orderBy(F.desc("hour"), F.desc("total_count"), "event")
    )


def latest_stats(totals: DataFrame) -> DataFrame:
    return totals.orderBy(F.desc("total_count"), "event")


def event_share(totals: DataFrame) -> DataFrame:
    """Each event's share of all events.  One row per event type comes in."""
    everything = F.sum("total_count").over(Window.partitionBy())
    return totals.withColumn("percentage", percent("total_count", everything)).orderBy(
        F.desc("total_count"), "event"
    )


def conversion_funnel(totals: DataFrame) -> DataFrame:
    """Stage totals and the three rates; a rate over zero is NULL."""
    stages = totals.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("event") == event, F.col("total_count"))), F.lit(0)).alias(name)
            for event, name in zip(S.EVENT_TYPES, ("views", "add_to_carts", "transactions"))
        ]
    )
    return stages.select(
        "*",
        percent("add_to_carts", "views").alias("view_to_cart_rate"),
        percent("transactions", "add_to_carts").alias("cart_to_transaction_rate"),
        percent("transactions", "views").alias("overall_conversion_rate"),
    )


# --- reports over recent clicks ---------------------------------------------


def _recent(clicks, as_of, lookback_ms):
    return clicks.where(F.col("timestamp") >= as_of - lookback_ms)


def top_items_recent(
    clicks: DataFrame, as_of: int, lookback_ms: int = HOUR, n: int = 10
) -> DataFrame:
    return (
        _recent(clicks, as_of, lookback_ms)
        .groupBy("itemid")
        .agg(F.count(F.lit(1)).alias("total_interactions"), *stage_counts(carts="add_to_carts"))
        .orderBy(F.desc("total_interactions"), "itemid")
        .limit(n)
    )


def active_users(
    clicks: DataFrame, as_of: int, lookback_ms: int = HOUR, n: int = 20
) -> DataFrame:
    return (
        _recent(clicks, as_of, lookback_ms)
        .groupBy("visitorid")
        .agg(
            F.count(F.lit(1)).alias("action_count"),
            F.count_distinct("event").alias("event_types"),
            F.count_distinct("itemid").alias("items_viewed"),
            F.min(event_second()).alias("first_action"),
            F.max(event_second()).alias("last_action"),
        )
        .orderBy(F.desc("action_count"), "visitorid")
        .limit(n)
    )


def event_timeline(
    clicks: DataFrame, as_of: int, lookback_ms: int = HOUR, n: int = 50
) -> DataFrame:
    """Counts per minute and event, newest minutes first."""
    return (
        _recent(clicks, as_of, lookback_ms)
        .groupBy(F.date_trunc("minute", event_second()).alias("minute"), "event")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy(F.desc("minute"), F.desc("event_count"), "event")
        .limit(n)
    )


def pipeline_health(
    clicks: DataFrame, windows: DataFrame, totals: DataFrame, as_of: int
) -> DataFrame:
    """Rows, newest time and its age in seconds, per stored table.

    The windowed table is as fresh as its last window, the totals as the last
    event they include.
    """
    now = F.unix_micros(F.timestamp_millis(F.lit(as_of)))

    def row(df, label, time):
        newest = F.max(time)
        return df.agg(F.count(F.lit(1)).alias("total_records"), newest.alias("last_event_time")).select(
            F.lit(label).alias("table_name"),
            "total_records",
            "last_event_time",
            ((now - F.unix_micros("last_event_time")) / F.lit(1_000_000.0)).alias(
                "seconds_since_last_event"
            ),
        )

    raw, windowed, cumulative = S.HEALTH_LABELS
    return (
        row(clicks, raw, event_second())
        .unionByName(row(windows, windowed, F.col("window_end")))
        .unionByName(row(totals, cumulative, F.col("updated_at")))
    )
