"""Error records: classification, storage rows, alerts and the failed-message log."""

import traceback
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide import schema as S
from clicktide.functions.columns import add_once, error_class
from clicktide.plans.scratch import exists, materialize


def classify_errors(df: DataFrame, message_col: str = "error_message") -> DataFrame:
    """Add ``error_type`` and ``severity``."""
    lowered = add_once(df, F.lower(message_col), "_lowered")
    return add_once(lowered, error_class("_lowered")).drop("_lowered")


def error_events(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Rows of the error table from (error_message, batch_id, raw_data).

    The whole message is classified and stored; ``max_chars`` cuts the stored
    text for tables with a shorter column.
    """
    now = F.current_timestamp()
    return classify_errors(df).select(
        "error_type",
        _cut("error_message", max_chars).alias("error_message"),
        "severity",
        F.col("raw_data").cast("string").alias("raw_data"),
        F.col("batch_id").cast("long").alias("batch_id"),
        now.alias("error_timestamp"),
        F.lit(0).alias("retry_count"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        now.alias("created_at"),
    )


def _cut(column, max_chars):
    return F.col(column) if max_chars is None else F.substring(column, 1, max_chars)


def error_alerts(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Alert rows for CRITICAL and ERROR, ready to be posted by a notifier.

    A notifier with a limit passes ``max_chars`` (``schema.ALERT_MESSAGE_CHARS``).
    """
    loud = df.where(F.col("severity").isin(*S.ALERT_COLORS))
    return loud.select(
        F.lit(S.ALERT_USERNAME).alias("username"),
        _lookup("severity", S.ALERT_COLORS).alias("color"),
        F.concat_ws(
            " ",
            _lookup("severity", S.ALERT_EMOJI),
            F.col("severity"),
            F.lit("-"),
            F.col("error_type"),
        ).alias("title"),
        _cut("error_message", max_chars).alias("text"),
        F.coalesce(F.col("batch_id").cast("string"), F.lit("N/A")).alias("batch_id"),
        F.lit(S.ALERT_FOOTER).alias("footer"),
    )


def handle_errors(df: DataFrame, path: str) -> DataFrame:
    """Append errors to the error table at ``path``; returns the alerts they raise."""
    stored = error_events(df)
    stored.write.mode("append").parquet(path)
    return error_alerts(stored)


def _lookup(column, mapping):
    pick = F
    for key, value in mapping.items():
        pick = pick.when(F.col(column) == key, F.lit(value))
    return pick


def failed_messages(
    df: DataFrame, error_type: str = "", error_message: str = "", trace: str = ""
) -> DataFrame:
    """Log rows for (key, value) messages that could not be published.

    ``raw_message`` is the whole message, ``message`` what of it fits the schema.
    ``df`` may bring the columns ``error_type``, ``error_message`` and ``trace`` of
    each message instead.
    """
    told = {"error_type": error_type, "error_message": error_message, "trace": trace}
    told = {c: F.col(c) if c in df.columns else F.lit(v) for c, v in told.items()}
    return df.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.monotonically_increasing_id().alias("index"),
        F.col("key").alias("partition_key"),
        F.from_json("value", S.EVENT_MESSAGE).alias("message"),
        F.col("value").cast("string").alias("raw_message"),
        F.struct(
            told["error_type"].alias("type"),
            told["error_message"].alias("message"),
            told["trace"].alias("traceback"),
        ).alias("error"),
    )


def log_failed_messages(rows: DataFrame, path: str) -> None:
    """Append log rows as JSON lines, one folder per day."""
    (
        rows.withColumn("date", F.substring("timestamp", 1, 10))
        .write.mode("append")
        .partitionBy("date")
        .json(path)
    )


def publish(
    messages: DataFrame, deliver: Callable[[str | None, str], None], log_path: str
) -> tuple[int, int]:
    """Deliver (key, value) messages one by one; returns how many were sent and how many failed.

    ``deliver`` runs in the tasks, once per message, and raises for a message that
    cannot be sent; it has to be picklable and opens its own connection.  Messages
    that fail go to the failed-message log, each with its own error.  A task that
    is repeated delivers its messages again.
    """
    told = messages.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    outcome = materialize(
        told.mapInArrow(
            partial(_deliver, deliver=deliver),
            "key string, value string, error_type string, error_message string, trace string",
        ),
        "published",
    )
    failed = outcome.where("error_type IS NOT NULL")
    counts = outcome.agg(F.count(F.lit(1)).alias("all"), F.count("error_type").alias("failed")).first()
    if counts["failed"]:
        log_failed_messages(failed_messages(failed), log_path)
    return counts["all"] - counts["failed"], counts["failed"]


def _trace(failure, stacks):
    """The text of ``traceback.format_exc``, with the part on the stack made once for each place of failure."""
    if failure.__cause__ or failure.__context__ or isinstance(failure, ExceptionGroup):
        return "".join(traceback.format_exception(failure))
    place, tb = [], failure.__traceback__
    while tb is not None:
        place.append((tb.tb_frame.f_code, tb.tb_lasti, tb.tb_lineno))
        tb = tb.tb_next
    place = tuple(place)
    if place not in stacks:
        if len(stacks) >= MOST_STACKS:
            stacks.clear()
        stacks[place] = "Traceback (most recent call last):\n" + "".join(traceback.format_tb(failure.__traceback__))
    return stacks[place] + "".join(traceback.format_exception_only(failure))


MOST_STACKS = 1000


def _deliver(batches, deliver):
    stacks = {}
    for batch in batches:
        errors = ([], [], [])
        for key, value in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist()):
            told = (None, None, None)
            try:
                deliver(key, value)
            except Exception as failure:  # whatever the sink raises is logged with the message
                told = (type(failure).__name__, str(failure), _trace(failure, stacks))
            for column, text in zip(errors, told):
                column.append(text)
        columns = [batch.column("key"), batch.column("value"), *(pa.array(c, pa.string()) for c in errors)]
        yield pa.RecordBatch.from_arrays(
            columns, names=["key", "value", "error_type", "error_message", "trace"]
        )


def failed_message_count(spark: SparkSession, path: str, day: str | None = None) -> int:
    """Logged messages of one day (today by default); 0 when there are none."""
    # the folders are named by the session's date
    day = day or spark.sql("SELECT string(current_date())").first()[0]
    folder = f"{path}/date={day}"
    if not exists(spark, folder):
        return 0
    return spark.read.text(folder).where(F.trim("value") != "").count()


def read_failed_messages(spark: SparkSession, path: str) -> DataFrame:
    """Logged messages with their errors, for another attempt."""
    return spark.read.schema(S.FAILED_MESSAGES).json(path)


def failed_message_counts(spark: SparkSession, path: str) -> DataFrame:
    """Logged messages per day."""
    return (
        spark.read.schema("value string, date string").text(path)
        .where(F.trim("value") != "")
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("failed_messages"))
    )
