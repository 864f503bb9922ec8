"""All jobs of the click stream in one query that reads and parses a batch once.

A batch is parsed into one cached frame and handed to each sink in turn.  A ledger
has a marker per batch and sink; a batch that is replayed repeats no sink whose
marker is there.  Statistics are kept as mergeable shares (see ``panes``), so the
query has no state of its own beside the tables.

``health`` has a row per batch: messages, valid and invalid ones, and valid events
that came too late for their pane.  A pane is too old once its last window has
ended more than the watermark's delay before the newest event of earlier batches.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clicktide import schema as S
from clicktide.sources.messages import as_json, dead_letter, parsed_messages
from clicktide.streaming import exact
from clicktide.streaming import panes as P
from clicktide.streaming.daily import DailyTable
from clicktide.streaming.pipeline import RAW_COLUMNS, failure_store
from clicktide.streaming.sinks import BatchWriter, append_batches, guarded

LATE_MS = 600_000 + S.WINDOW_SIZE_MS - S.WINDOW_SLIDE_MS
FOLD_EVERY = 10
_KEPT = 5


class Ledger:
    """Which sinks have finished which batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.new_path = root, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.new_path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, batch_id, sink):
        return self.new_path(f"{self.root}/batch={batch_id}/{sink}")

    def done(self, batch_id: int, sink: str) -> bool:
        return self.fs.exists(self._marker(batch_id, sink))

    def finish(self, batch_id: int, sink: str) -> None:
        self.fs.create(self._marker(batch_id, sink), True).close()

    def forget(self, batch_id: int) -> None:
        """Drop the markers of a batch that can't be replayed any more."""
        self.fs.delete(self.new_path(f"{self.root}/batch={batch_id}"), True)


def fan_out(
    prepare: Callable[[DataFrame], DataFrame], sinks: dict[str, BatchWriter], ledger: str,
    after: Callable[[int], None] | None = None,
) -> BatchWriter:
    """Prepare a batch once and give it to every sink that has not finished it.

    A sink that raises stops the query; on restart the batch goes only to it and to
    those after it.  ``after`` runs outside of all sinks, for upkeep: its failure is
    that of no batch and is tried again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        told = Ledger(batch.sparkSession, ledger)
        left = [name for name in sinks if not told.done(batch_id, name)]
        if left:
            ready = prepare(batch).persist()
            try:
                for name in left:
                    sinks[name](ready, batch_id)
                    told.finish(batch_id, name)
            finally:
                ready.unpersist()
        told.forget(batch_id - _KEPT)
        if after:
            after(batch_id)

    return write


# --- the tables -------------------------------------------------------------


PAIR_KEYS = ["event", "kind", "who"]


def _added_up(_columns=None):
    return [F.sum("n").alias("n")]


class ClickTables:
    """The tables below one root."""

    def __init__(self, spark: SparkSession, root: str, fold_after: int = 8):
        self.spark, self.root = spark, root
        self.live = DailyTable(spark, f"{root}/live_clickstream_events", F.col("event_date"), fold_after=fold_after)
        self.panes = P.pane_table(spark, f"{root}/panes", additive=True, fold_after=fold_after)
        one_day = F.lit("1970-01-01")  # a row per event and its visitor or item, of whatever day
        self.totals = DailyTable(spark, f"{root}/event_statistics", one_day, PAIR_KEYS, _added_up, fold_after)
        self.health = DailyTable(spark, f"{root}/health", F.col("at"), ["batch_id"], fold_after=fold_after)

    def fold(self) -> None:
        for table in (self.live, self.panes, self.totals, self.health):
            table.fold()

    # -- sinks; each gets the parsed batch -----------------------------------

    def _too_late(self):
        newest = self.panes.manifest().notes.get("newest_ms")
        pane_end = F.col("timestamp") - F.pmod("timestamp", F.lit(S.WINDOW_SLIDE_MS)) + S.WINDOW_SLIDE_MS
        return F.lit(False) if newest is None else pane_end <= newest - LATE_MS

    def write_health(self, parsed: DataFrame, batch_id: int) -> None:
        # before the panes of the batch: they move the newest time on
        valid = F.col("valid")
        counted = parsed.agg(
            F.count(F.lit(1)).alias("messages"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"),
            F.count_if(valid & self._too_late()).alias("late"),
        )
        row = counted.select(F.lit(batch_id).cast("long").alias("batch_id"), F.current_timestamp().alias("at"), "*")
        self.health.write(row, batch_id)

    def write_live(self, parsed: DataFrame, batch_id: int) -> None:
        rows = parsed.where("valid").select(*RAW_COLUMNS, F.to_date("event_time").alias("event_date"))
        self.live.write(rows, batch_id)

    def write_panes(self, parsed: DataFrame, batch_id: int) -> None:
        if self.panes.manifest().batch_id >= batch_id:
            return
        events = parsed.where("valid")
        newest = events.agg(F.max("timestamp")).first()[0]
        before = self.panes.manifest().notes.get("newest_ms")
        known = [ms for ms in (newest, before) if ms is not None]
        kept = P.pane_counts(events.where(~self._too_late()))
        self.panes.write(kept, batch_id, {"newest_ms": max(known)} if known else {})

    def write_totals(self, parsed: DataFrame, batch_id: int) -> None:
        pairs = exact.sides(parsed.where("valid")).groupBy("event", "s.kind", "s.who")
        self.totals.write(pairs.agg(F.count(F.lit(1)).alias("n")), batch_id)

    # -- readers ---------------------------------------------------------------

    def read_windows(self, first: str | None = None, last: str | None = None) -> DataFrame:
        return P.read_windows(self.panes, first, last)

    def read_totals(self) -> DataFrame:
        kind = F.col("kind")
        return self.totals.read().groupBy("event").agg(
            F.sum(F.when(kind == exact.ROWS, F.col("n"))).alias("total_count"),
            F.count_if(kind == exact.VISITOR).alias("unique_visitors"),
            F.count_if(kind == exact.ITEM).alias("unique_items"),
        )

    def read_health(self) -> DataFrame:
        return self.health.read()


def start_fan_out(
    messages: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, name: str | None = None
) -> StreamingQuery:
    """Run all jobs of the click stream as one query.

    A sink that cannot write a batch sends it to ``root/failed_batches`` with a record and
    an alert, as :func:`pipeline.start_pipeline` does, and the others go on.
    """
    spark = messages.sparkSession
    tables = ClickTables(spark, root)
    dead = append_batches(f"{root}/error_data", "text")

    def write_dead(parsed, batch_id):
        dead(as_json(dead_letter(parsed.where("NOT valid").select("raw_message"))), batch_id)

    writers = {
        "health": tables.write_health, "live_clickstream_events": tables.write_live, "error_data": write_dead,
        "panes": tables.write_panes, "event_statistics": tables.write_totals,
    }
    sinks = {n: guarded(w, failure_store(root, n)) for n, w in writers.items()}

    def upkeep(batch_id):
        if (batch_id + 1) % FOLD_EVERY == 0:
            tables.fold()

    write = fan_out(parsed_messages, sinks, f"{root}/_ledger", upkeep)
    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(**trigger) if trigger else writer).start()
