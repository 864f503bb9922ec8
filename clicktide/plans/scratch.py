"""Intermediate tables in the folder all executors share.

A job that has to read one computed frame several times, or that depends on
the rows of a frame staying put, writes it as Parquet.  The table survives the
loss of any executor, and its size is known to the optimizer when it is read.
"""

import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Tables of the innermost open scope are at the end; the first list belongs to no scope.
_made: list[list[str]] = [[]]
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else the context's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="clicktide-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/clicktide/{app}/{label}-{uuid.uuid4().hex[:12]}"
    _made[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The same with the number of rows, counted from the footers of the written files."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return table, table.count()


def materialize_in_turn(spark: SparkSession, label: str, make: Callable[[], Iterable[DataFrame]]) -> DataFrame:
    """Write the frames that ``make`` gives, of like columns, one after the other as one table.

    The shuffle files of a frame are gone before the next one starts, and at the
    end the tables made on the way are deleted.
    """
    path = new_path(spark, label)
    with scope(spark), brief_shuffles(spark):
        for df in make():
            df.write.mode("append").parquet(path)
            schema = df.schema
    return spark.read.schema(schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Statements run inside delete their shuffle files when they end.

    Otherwise the files stay until the driver's garbage happens to be collected.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Delete the tables made outside of any scope; call when their readers are done."""
    _delete(spark, _made[0])


@contextmanager
def scope(spark: SparkSession):
    """Tables made inside are deleted at its end, and no others."""
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.pop()
        _delete(spark, made)


def _delete(spark, made):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while made:
        path = jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(conf).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
