"""Micro-batch sinks.

Every sink writes a batch into a folder named after its batch id and replaces
that folder when the batch is replayed, so a restart repeats nothing.  A target
belongs to one checkpoint: start over with both or with neither.
"""

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clicktide import schema as S
from clicktide.operators.errors import error_alerts, error_events
from clicktide.plans.scratch import exists
from clicktide.sources.messages import as_json, failed_batch

_log = logging.getLogger(__name__)

BatchWriter = Callable[[DataFrame, int], None]


# --- append -----------------------------------------------------------------


def append_batches(target: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite").format(fmt).partitionBy(*partition_by)
        writer.save(f"{target}/batch_id={batch_id}")

    return write


def jdbc_append(url: str, table: str, **options) -> BatchWriter:
    """Append to a relational table.

    A database cannot be told that a batch is a replay, so rows carry a key
    (:func:`with_replay_key`) by which the table or its reader drops repeats.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = with_replay_key(batch, batch_id)
        rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()

    return write


def with_replay_key(batch: DataFrame, batch_id: int) -> DataFrame:
    """Add ``batch_id, row_hash, copy``: the same for a row of a replayed batch, never for two rows of one batch."""
    same = Window.partitionBy("row_hash", *batch.columns).orderBy("row_hash")
    return (
        batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .withColumn("row_hash", F.xxhash64(*batch.columns))
        .withColumn("copy", F.row_number().over(same))
    )


def kafka_append(servers: str, topic: str) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        as_json(batch).write.format("kafka").options(
            **{"kafka.bootstrap.servers": servers, "topic": topic}
        ).save()

    return write


# --- upsert -----------------------------------------------------------------


def upsert_batches(
    target: str, stamp: str, keys: list[str] | None = None, compact_every: int = 20
) -> BatchWriter:
    """Keep each batch's rows as changes; ``stamp`` is set to the time of writing.

    With ``keys`` the table compacts itself after every ``compact_every`` batches,
    so readers never see more folders than that besides a snapshot.  What the
    snapshot before replaces is deleted; readers of the newest one go on.

    Rows with the same key are merged on reading (:func:`read_upserts`), the
    newest batch winning.  No existing file is touched, so a failed write can
    lose nothing, and the cost of a batch does not grow with the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        changes = batch.withColumn(stamp, F.current_timestamp())
        changes.write.mode("overwrite").parquet(f"{target}/changes/batch_id={batch_id}")
        if keys and (batch_id + 1) % compact_every == 0:
            _fold(batch.sparkSession, target, keys)

    return write


def _fold(spark, target, keys):
    """The batch is in the table already: a fold that fails is not its failure, and the next one makes up for it."""
    try:
        before = _newest(spark, f"{target}/snapshots/upto=*")
        compact_upserts(spark, target, keys)
        if before is not None:
            _drop_until(spark, target, before)
    except Exception:
        _log.warning("the changes of %s could not be folded; they are read as they are", target, exc_info=True)


def read_upserts(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The current row of every key, from complete batches only."""
    folded = _newest(spark, f"{target}/snapshots/upto=*")
    # a folder without its marker may hold a part of a batch
    complete = [(n, f) for n, f in _complete(spark, f"{target}/changes/batch_id=*") if folded is None or n > folded]
    if folded is None and not complete:
        raise FileNotFoundError(f"no complete batch in {target}")
    parts = []
    if complete:
        paths = [f.toString() for _, f in sorted(complete, key=lambda x: x[0])]
        parts.append(
            spark.read.option("basePath", f"{target}/changes").parquet(*paths)
            .withColumn("batch_id", F.col("batch_id").cast("long"))
        )
    if folded is not None:
        snapshot = spark.read.parquet(f"{target}/snapshots/upto={folded}")
        parts.append(snapshot.withColumn("batch_id", F.lit(folded).cast("long")))
    changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    values = [c for c in changes.columns if c not in keys and c != "batch_id"]
    return changes.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])


def compact_upserts(spark: SparkSession, target: str, keys: list[str]) -> int:
    """Fold all complete batches into a snapshot; returns the last one in it.

    Readers use the newest snapshot that is complete and the batches after it,
    so the stream may go on meanwhile.
    """
    upto = max(
        n for n in (_newest(spark, f"{target}/changes/batch_id=*"), _newest(spark, f"{target}/snapshots/upto=*"))
        if n is not None
    )
    if upto == _newest(spark, f"{target}/snapshots/upto=*"):
        return upto  # nothing has come since
    current = read_upserts(spark, target, keys)
    current.write.mode("overwrite").parquet(f"{target}/snapshots/upto={upto}")
    return upto


def drop_folded(spark: SparkSession, target: str) -> None:
    """Delete batches and snapshots that the newest snapshot has replaced.

    Call it while nobody reads the table; the stream may go on.
    """
    folded = _newest(spark, f"{target}/snapshots/upto=*")
    if folded is not None:
        _drop_until(spark, target, folded)


def _drop_until(spark, target, folded):
    """Delete what the snapshot ``folded`` replaces: older snapshots, and batches up to it."""
    for pattern in (f"{target}/changes/batch_id=*", f"{target}/snapshots/upto=*"):
        for number, folder in _complete(spark, pattern):
            if number < folded or (number == folded and "/changes/" in pattern):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _newest(spark, pattern):
    return max((number for number, _ in _complete(spark, pattern)), default=None)


def _complete(spark, pattern):
    """(number, path) of the folders whose success marker is written."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = marker.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marker)
    folders = [f.getPath().getParent() for f in found]
    return [(int(f.getName().split("=")[1]), f) for f in folders]


# --- failures ---------------------------------------------------------------


def store_failure(
    dead_letters: str, errors: str, table: str, alerts: str | None = None
) -> Callable[[DataFrame, int, str], None]:
    """Keep a failed batch for reprocessing, record the error and, given a path, raise its alert.

    The first line of the message is classified and stored; the whole text, which
    may hold a stack trace, goes to the raw data.
    """

    def store(batch: DataFrame, batch_id: int, message: str) -> None:
        as_json(failed_batch(batch, batch_id, message)).write.mode("overwrite").text(
            f"{dead_letters}/table={table}/batch_id={batch_id}"
        )
        record = batch.sparkSession.createDataFrame(
            [(message.strip().split("\n")[0], batch_id)], "error_message string, batch_id long"
        ).withColumn(
            "raw_data", F.to_json(F.struct(F.lit(table).alias("table"), F.lit(message).alias("error")))
        )
        place = f"source_table={table}/source_batch={batch_id}"
        error_events(record).write.mode("overwrite").parquet(f"{errors}/{place}")
        if alerts:
            stored = batch.sparkSession.read.schema(S.ERROR_EVENTS).parquet(f"{errors}/{place}")
            error_alerts(stored).write.mode("overwrite").parquet(f"{alerts}/{place}")

    return store


def guarded(write: BatchWriter, on_failure: Callable[[DataFrame, int, str], None]) -> BatchWriter:
    """Route a batch that cannot be written to ``on_failure`` and carry on.

    If that fails too, the query stops and the batch is replayed on restart.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            write(batch, batch_id)
        except Exception as failure:  # any sink error ends up in the dead letters
            on_failure(batch, batch_id, f"{type(failure).__name__}: {failure}")

    return run


def read_errors(spark: SparkSession, errors: str) -> DataFrame:
    """Error records stored by :func:`store_failure`, with the table they concern."""
    if not exists(spark, errors):
        raise FileNotFoundError(errors)
    return spark.read.schema(S.ERROR_EVENTS).parquet(errors)
