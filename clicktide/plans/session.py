"""Session settings the operators rely on."""

import os
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTINGS = {
    # stored timestamps are zoneless UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; cluster sizing is left alone."""
    importable(spark)
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def importable(spark: SparkSession) -> None:
    """Let local Python workers import this package, whatever folder the session was started in.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (home, known) if p)


@contextmanager
def state_store_per_core(spark: SparkSession):
    """Start new stateful streams with one shuffle partition per core.

    Each partition keeps a state store that is committed in every batch, and
    adaptive execution does not merge them.  A stream takes the number over when
    it starts and keeps it for the life of its checkpoint.
    """
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(setting, before)
