"""Sliding-window statistics of a stream, from panes of one slide.

An event goes into one pane, never into each of its windows.  A pane keeps a count
and two mergeable sketches; a window is the union of its panes, made when it is
read.  Panes can be added up: those of two batches, or of a late event, merge.

A pane takes events until the last window that holds it is behind the watermark.
An event that is late for some of its windows only is in all of them, also in
those that have closed: no window open at its arrival lacks it, and windows agree
with their panes.
"""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide import schema as S
from clicktide.operators.stats import SKETCH_LG
from clicktide.streaming.daily import DailyTable

PANE_KEYS = ["pane_start", "event"]
# a pane is as late as the last window it is in
PANE_DELAY = f"{10 * 60 + (S.WINDOW_SIZE_MS - S.WINDOW_SLIDE_MS) // 1000} seconds"


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.theta_sketch_agg("visitorid", SKETCH_LG).alias("users"),
        F.theta_sketch_agg("itemid", SKETCH_LG).alias("items"),
    ]


def merged_measures(_columns=None) -> list[Column]:
    """Panes of one key added up."""
    return [
        F.sum("event_count").alias("event_count"),
        F.theta_union_agg("users", SKETCH_LG).alias("users"),
        F.theta_union_agg("items", SKETCH_LG).alias("items"),
    ]


def pane_counts(events: DataFrame) -> DataFrame:
    """``pane_start, event, event_count, users, items`` of a frame or stream with ``event_time``."""
    pane = F.window("event_time", S.WINDOW_SLIDE)  # as long as the slide: a projection, no copies
    counted = events.withWatermark("event_time", PANE_DELAY) if events.isStreaming else events
    return counted.groupBy(pane.alias("pane"), "event").agg(*_measures()).select(
        F.col("pane.start").alias("pane_start"), "event", "event_count", "users", "items"
    )


def windows_of_panes(panes: DataFrame) -> DataFrame:
    """Per sliding window and event: rows, distinct users and items, from the panes."""
    k = S.WINDOW_SIZE_MS // S.WINDOW_SLIDE_MS
    start = F.unix_millis("pane_start")
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: start - i * S.WINDOW_SLIDE_MS))
    return (
        panes.select("event", "event_count", "users", "items", starts.alias("start"))
        .groupBy("start", "event")
        .agg(*merged_measures())
        .select(
            F.timestamp_millis("start").alias("window_start"),
            F.timestamp_millis(F.col("start") + S.WINDOW_SIZE_MS).alias("window_end"),
            "event",
            "event_count",
            F.theta_sketch_estimate("users").alias("unique_users"),
            F.theta_sketch_estimate("items").alias("unique_items"),
        )
    )


def pane_table(spark: SparkSession, target: str, additive: bool = False, fold_after: int = 8) -> DailyTable:
    """The stored panes, by day.

    A stateful query sends whole panes again when they change; with ``additive`` every
    batch sends only its own share and shares are added up.
    """
    more = {"merge": merged_measures} if additive else {}
    return DailyTable(spark, target, F.col("pane_start"), PANE_KEYS, fold_after=fold_after, **more)


def read_windows(panes: DailyTable, first: str | None = None, last: str | None = None) -> DataFrame:
    """Windows that start on the days ``first`` to ``last``; opens those days and the one after."""
    after = str(date.fromisoformat(last) + timedelta(days=1)) if last else None
    windows = windows_of_panes(panes.read(first, after))
    if first:
        windows = windows.where(F.to_date("window_start") >= F.lit(first).cast("date"))
    if last:
        windows = windows.where(F.to_date("window_start") <= F.lit(last).cast("date"))
    return windows
