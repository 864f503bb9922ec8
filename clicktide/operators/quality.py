"""Data-quality checks on the click table."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide import schema as S

DUPLICATE_KEYS = ("timestamp", "visitorid", "event", "itemid")


class DataQualityError(ValueError):
    """A check failed and the caller asked to stop there."""


def duplicate_events(
    clicks: DataFrame, keys: tuple[str, ...] = DUPLICATE_KEYS, n: int | None = 10
) -> DataFrame:
    """Keys that occur more than once, most copies first; ``n=None`` for all."""
    repeated = (
        clicks.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .where(F.col("cnt") > 1)
    )
    return repeated if n is None else repeated.orderBy(F.desc("cnt"), *keys).limit(n)


def invalid_event_types(clicks: DataFrame, allowed: tuple[str, ...] = S.EVENT_TYPES) -> DataFrame:
    """Event names outside the vocabulary, with their row counts."""
    odd = F.col("event").isNull() | ~F.col("event").isin(*allowed)
    return clicks.where(odd).groupBy("event").agg(F.count(F.lit(1)).alias("events"))


def validate_table(spark: SparkSession, name: str) -> int:
    """Row count of a catalog table; raises when there is no such table."""
    if not spark.catalog.tableExists(name):
        raise DataQualityError(f"table {name} does not exist")
    return spark.table(name).count()


def validate_schema(df: DataFrame, required: dict[str, str]) -> DataFrame:
    """One row: record count and the required columns that are missing or mistyped."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema}
    missing = sorted(c for c in required if c not in actual)
    mistyped = sorted(c for c, t in required.items() if c in actual and actual[c] != t)
    return df.agg(F.count(F.lit(1)).alias("records")).select(
        "records",
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(",".join(mistyped)).alias("mistyped_columns"),
        (F.col("records").isNotNull() & F.lit(not missing and not mistyped)).alias("passed"),
    )


def sample_check(
    clicks: DataFrame, required: tuple[str, ...] = ("visitorid", "itemid", "event"), n: int | None = None
) -> int:
    """Rows of the table, or of its first ``n``; raises when it cannot be trained on."""
    missing = [c for c in required if c not in clicks.columns]
    if missing:
        raise DataQualityError(f"missing columns: {', '.join(missing)}")
    rows = (clicks if n is None else clicks.limit(n)).count()
    if rows == 0:
        raise DataQualityError("no data")
    return rows


def constraint_violations(
    df: DataFrame,
    not_null: tuple[str, ...] = (),
    unique: tuple[tuple[str, ...], ...] = (),
    max_length: dict[str, int] | None = None,
) -> DataFrame:
    """Violations per declared rule.

    NOT NULL and length rules share one pass.  A unique rule counts the rows
    beyond the first of each key; keys with a NULL part never clash.
    """
    lengths = max_length or {}
    flags = [
        (f"not_null({c})", F.count_if(F.col(c).isNull())) for c in not_null
    ] + [
        (f"length({c}<={n})", F.count_if(F.length(c) > n)) for c, n in lengths.items()
    ]
    parts = []
    if flags:
        counted = df.agg(*[flag.alias(f"r{i}") for i, (_, flag) in enumerate(flags)])
        pairs = F.array(
            *[F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations"))
              for i, (rule, _) in enumerate(flags)]
        )
        parts.append(counted.select(F.inline(pairs)))
    for keys in unique:
        complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        parts.append(
            df.where(complete)
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("copies"))
            .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("violations"))
            .select(F.lit(f"unique({','.join(keys)})").alias("rule"), "violations")
        )
    return reduce(DataFrame.unionByName, parts)


def data_quality_report(clicks: DataFrame, fail_fast: bool = False) -> DataFrame:
    """(check_name, passed, n_bad) for schema, emptiness, duplicates and vocabulary."""
    absent = [c for c in S.REQUIRED_EVENT_COLUMNS if c not in clicks.columns]
    if absent:
        raise DataQualityError(f"missing columns: {', '.join(absent)}")
    # one aggregation by key answers all checks; its rows are counted, not the table's
    keys = clicks.groupBy(*DUPLICATE_KEYS).agg(F.count(F.lit(1)).alias("rows"))
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in S.REQUIRED_EVENT_COLUMNS])
    odd = F.col("event").isNull() | ~F.col("event").isin(*S.EVENT_TYPES)
    counted = keys.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("not_empty"),
        F.count_if(F.col("rows") > 1).alias("duplicates"),
        F.count_distinct(F.when(odd, F.struct("event"))).alias("event_types"),
        F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("required_values"),
    )
    names = ("not_empty", "duplicates", "event_types", "required_values")
    checks = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("n_bad")) for n in names])
    report = counted.select(F.inline(checks)).select(
        "check_name", (F.col("n_bad") == 0).alias("passed"), "n_bad"
    )
    if fail_fast:
        bad = report.where(~F.col("passed")).collect()  # at most one row per check
        if bad:
            raise DataQualityError("; ".join(f"{r.check_name}: {r.n_bad}" for r in bad))
    return report
