"""Joins that stay balanced when a few keys own most of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys joined by broadcast: as many as there are shuffle partitions, at least
# HOT_KEYS.  Any key below the cut then owns less than a task's share of the rows.
HOT_KEYS = 1024


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    key: str,
    weight: str,
    spread_by: list[str],
    hot_keys: int | None = None,
) -> DataFrame:
    """Left join of ``big`` with a table that has one row per ``key``.

    ``weight`` is the number of rows (or anything that grows with it) that the
    key has in ``big``.  The heaviest keys meet their table row by broadcast.
    Their rows then carry a second key drawn from ``spread_by``, so the shuffle
    for the remaining keys deals them out over all tasks.
    """
    if hot_keys is None:
        hot_keys = max(HOT_KEYS, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [c for c in table.columns if c != key]
    row = F.struct(*columns)
    table = table.where(F.col(key).isNotNull())  # lets both uses share one shuffle
    hot = (
        table.orderBy(F.desc(weight), F.col(key))
        .limit(hot_keys)
        .select(F.col(key), row.alias("_hot"))
    )
    anywhere = 1 + F.pmod(F.xxhash64(*spread_by), F.lit(2**31 - 1))
    flagged = big.join(F.broadcast(hot), key, "left").withColumn(
        "_spread", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(anywhere)
    )
    # A plain literal would be folded into the condition, and the shuffle would
    # go back to hashing the key alone; a generated zero stays a join key.
    zero = F.explode(F.array(F.lit(0).cast("long"))).alias("_spread")
    rest = table.select(F.col(key), zero, row.alias("_rest"))
    joined = flagged.join(rest, [key, "_spread"], "left")
    found = F.coalesce("_hot", "_rest")
    return joined.select(*[F.col(c) for c in big.columns], *[found[c].alias(c) for c in columns])


def semi_join(
    big: DataFrame, keys: DataFrame, key: str, spread_by: list[str], salts: int = 16
) -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``keys`` (one column, distinct).

    Every key is repeated once per salt, so that a key owning a large part of
    ``big`` is shared out over ``salts`` tasks.  The copies are never broadcast:
    the optimizer sees the size of the stored keys, not of what they unfold to.
    """
    repeated = keys.select(
        key, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    ).hint("merge")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return salted.join(repeated, [key, "_salt"], "left_semi").select(*big.columns)
