"""The stored tables and their views under the names SQL users know."""

from pyspark.sql import DataFrame

from clicktide import schema as S
from clicktide.operators import stats
from clicktide.sources.tables import latest_ms


def create_views(
    clicks: DataFrame, windows: DataFrame, totals: DataFrame, as_of: int | None = None
) -> None:
    """Register the three tables and the views on them in the session.

    ``realtime_metrics`` looks back one hour from ``as_of``, by default from the
    newest window.
    """
    if as_of is None:  # the newest window starts in the pane of the newest click
        newest = latest_ms(clicks) or 0
        as_of = newest - newest % S.WINDOW_SLIDE_MS
    frames = {
        "clickstream_events": clicks,
        "windowed_stats": windows,
        "event_statistics": totals,
        "event_summary": stats.event_summary(clicks),
        "realtime_metrics": stats.realtime_metrics(windows, as_of),
        "latest_stats": stats.latest_stats(totals),
    }
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
