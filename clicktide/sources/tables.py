"""Click tables from stored event tables."""

import re
from datetime import datetime, timedelta, timezone
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def clickstream_from_events(events: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Map (event_id, ts, user_id, event_type, props) to the click table.

    ``since_ms`` becomes a comparison on the stored ``ts`` column, which the
    Parquet scan can use to skip row groups.
    """
    if since_ms is not None:
        # row groups are skipped on the stored column; the exact test follows below
        bound = datetime.fromtimestamp(since_ms // 1000, timezone.utc).replace(tzinfo=None)
        events = events.where(F.col("ts") >= F.lit(bound).cast("timestamp_ntz"))
    kind = F.col("event_type")
    clicks = events.select(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("user_id").alias("visitorid"),
        F.when(kind == "click", "addtocart")
        .when(kind == "purchase", "transaction")
        .otherwise(kind)
        .alias("event"),
        F.get_json_object("props", "$.k").cast("long").alias("itemid"),
        F.when(kind == "purchase", F.col("event_id")).alias("transactionid"),
    )
    return clicks if since_ms is None else clicks.where(F.col("timestamp") >= since_ms)


def clickstream_from_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Purchases of an order table as clicks: one transaction per line item."""
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    heads = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        F.col("o_custkey").alias("visitorid"),
        F.lit("transaction").alias("event"),
        F.col("l_partkey").alias("itemid"),
        F.col("l_orderkey").alias("transactionid"),
    )


def latest_ms(clicks: DataFrame) -> int:
    """Newest event time in milliseconds: the default ``as_of`` of a report."""
    return clicks.agg(F.max("timestamp")).first()[0]


def newest_in_files(spark: SparkSession, path: str, column: str) -> int | None:
    """The largest value of a column of a Parquet table, from the statistics in its footers.

    For whole numbers and timestamps (then epoch milliseconds, rounded down).  Tasks read the footers; no
    data page is opened but of files that have no statistics of the column.  None for a
    table without values.
    """
    table = spark.read.parquet(path)
    files = spark.createDataFrame([(f,) for f in table.inputFiles()], "path string")
    tasks = max(1, min(files.count() // FOOTERS_PER_TASK, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    told = files.repartition(tasks).mapInArrow(partial(_footers, column=column), "path string, known boolean, newest long")
    kinds = told.groupBy("known").agg(F.max("newest").alias("newest"), F.collect_list(F.when(~F.col("known"), F.col("path"))).alias("paths"))
    found = []
    for row in kinds.collect():  # two rows at most
        if row["known"]:
            found.append(row["newest"])
        else:
            found.append(_scanned(spark.read.schema(table.schema).parquet(*row["paths"]), column))
    return max((n for n in found if n is not None), default=None)


FOOTERS_PER_TASK = 64


def _scanned(table, column):
    value = F.col(column)
    if table.schema[column].dataType.typeName().startswith("timestamp"):
        value = F.unix_millis(value.cast("timestamp"))
    return table.agg(F.max(value)).first()[0]


def _footers(batches, column):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            known, newest = _newest_of_file(path, column)
            yield pa.RecordBatch.from_pydict(
                {"path": [path], "known": [known], "newest": pa.array([newest], pa.int64())}
            )


def _newest_of_file(path, column):
    """(whether the footer tells, the largest value)."""
    try:
        system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    except pa.ArrowInvalid:
        return False, None  # a file system only Spark knows
    with system.open_input_file(place) as source:
        footer = pq.ParquetFile(source).metadata
    at = footer.schema.to_arrow_schema().get_field_index(column)
    newest = None
    for group in range(footer.num_row_groups):
        stats = footer.row_group(group).column(at).statistics
        values = footer.row_group(group).num_rows - (stats.null_count if stats and stats.has_null_count else 0)
        if not values:
            continue
        if stats is None or not stats.has_min_max:
            return False, None
        largest = stats.max
        if isinstance(largest, datetime):
            # the statistics of zoneless times are UTC, as the session is
            largest = (largest.replace(tzinfo=timezone.utc) - _EPOCH) // timedelta(milliseconds=1)
        elif not isinstance(largest, int):
            return False, None
        newest = largest if newest is None else max(newest, largest)
    return True, newest


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A SQL query on a relational database, as a frame.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` together with ``dbtable`` instead of a query for a
    parallel read of a large table.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if "dbtable" not in options:
        reader = reader.option("query", query)
    return reader.load()
