"""Exact distinct counts of a stream.

The state has one entry per (event, visitor) and (event, item), with the times of
the batches that saw it first and last, and one per event with its number of rows.
Equal keys are merged before the shuffle, so an event or visitor that owns much of
a batch sends one row a task.  A pair is new in the batch where both times
are the same; the number of new pairs is added to the totals of the batch before.

State grows with the number of distinct pairs, not with the number of events; keep it in
RocksDB (``plans.session``).  An entry is a key and three numbers, about 60 bytes.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clicktide.streaming.sinks import BatchWriter, _complete

_KEPT = 3
ROWS, VISITOR, ITEM = "rows", "visitor", "item"


def sides(events: DataFrame, *more) -> DataFrame:
    """``event, s.kind, s.who``: every event as a row, as its visitor and as its item, if it has them."""
    def side(kind, who):
        return F.struct(F.lit(kind).alias("kind"), who.cast("long").alias("who"))

    each = F.array(side(ROWS, F.lit(None)), side(VISITOR, F.col("visitorid")), side(ITEM, F.col("itemid")))
    return events.select("event", *more, F.explode(each).alias("s")).where("s.kind = 'rows' OR s.who IS NOT NULL")


def first_seen(events: DataFrame) -> DataFrame:
    """``event, kind, who, first, last, n`` of every pair (and, as kind ``rows``, every event) a batch touches."""
    return (
        sides(events, F.current_timestamp().alias("at"))
        .groupBy("event", "s.kind", "s.who")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    )


def _newest(spark, target, below):
    found = [n for n, _ in _complete(spark, f"{target}/batch_id=*") if below is None or n < below]
    return max(found, default=None)


def add_batch(target: str, then: BatchWriter | None = None):
    """A writer that keeps the totals after each batch; a replayed batch starts from the totals before it again.

    ``then`` gets the totals of all events after each batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = F.col("first") == F.col("last")
        told = batch.groupBy("event").agg(
            F.max(F.when(F.col("kind") == ROWS, F.col("n"))).alias("total_count"),
            F.count_if((F.col("kind") == VISITOR) & new).alias("unique_visitors"),
            F.count_if((F.col("kind") == ITEM) & new).alias("unique_items"),
        )
        before = _newest(spark, target, batch_id)
        if before is not None:
            told = told.unionByName(spark.read.parquet(f"{target}/batch_id={before}").drop("updated_at"))
        totals = told.groupBy("event").agg(
            F.max("total_count").alias("total_count"),  # the state's count of rows only grows
            F.sum("unique_visitors").alias("unique_visitors"),
            F.sum("unique_items").alias("unique_items"),
        )
        totals = totals.withColumn("updated_at", F.current_timestamp())
        totals.coalesce(1).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")  # one row per event
        for number, folder in _complete(spark, f"{target}/batch_id=*"):
            if number <= batch_id - _KEPT:
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if then:
            then(spark.read.schema(totals.schema).parquet(f"{target}/batch_id={batch_id}").drop("updated_at"), batch_id)

    return write


def stream_exact_statistics(
    events: DataFrame, target: str, checkpoint: str, trigger: dict | None = None, name: str | None = None
) -> StreamingQuery:
    """Keep exact statistics per event; events without a visitor or item count as rows only."""
    writer = first_seen(events).writeStream.outputMode("update").foreachBatch(add_batch(target))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_exact(spark: SparkSession, target: str) -> DataFrame:
    """``event, total_count, unique_visitors, unique_items, updated_at`` after the newest batch."""
    newest = _newest(spark, target, None)
    if newest is None:
        raise FileNotFoundError(f"no complete batch in {target}")
    return spark.read.parquet(f"{target}/batch_id={newest}")
