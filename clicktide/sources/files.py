"""Bulk loads from CSV files."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktide import schema as S
from clicktide.plans.scratch import exists


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Columns in the order of the header; a cell, row or header that doesn't fit raises."""
    header = spark.read.option("header", True).csv(path).columns
    if sorted(header) != sorted(schema.names):
        raise ValueError(f"{path} has the columns {header}, not {schema.names}")
    ordered = T.StructType([schema[name] for name in header])
    rows = spark.read.schema(ordered).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)
    return rows.select(*schema.names)


def read_events_csv(spark: SparkSession, path: str, sample: int = 0) -> DataFrame:
    """Events with a header row; ``sample`` > 0 keeps that many rows only.

    Reading fails at a cell that is not of its column's type;
    :func:`unreadable_cells` counts such cells beforehand.
    """
    events = _read_csv(spark, path, S.EVENTS_CSV)
    return events.limit(sample) if sample > 0 else events


def unreadable_cells(spark: SparkSession, path: str, schema: T.StructType = S.EVENTS_CSV) -> DataFrame:
    """``column, cells``: how many cells of each column are not of its type."""
    text = spark.read.option("header", True).csv(path)
    bad = [
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
        for f in schema
    ]
    names = F.array(
        *[F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("cells")) for f in schema]
    )
    return text.agg(*bad).select(F.inline(names))


def read_category_tree(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, S.CATEGORY_TREE)


def read_item_properties(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All parts that exist; each may have its own order of columns."""
    present = [p for p in paths if exists(spark, p)]
    if not present:
        return spark.createDataFrame([], S.ITEM_PROPERTIES)
    return reduce(DataFrame.unionByName, [_read_csv(spark, p, S.ITEM_PROPERTIES) for p in present])


def load_category_tree(spark: SparkSession, path: str, target: str) -> int:
    """Replace the category table; returns its row count."""
    tree = read_category_tree(spark, path)
    bad = (
        tree.groupBy("categoryid").count()
        .where(F.col("categoryid").isNull() | (F.col("count") > 1))
        .limit(1).count()
    )
    if bad:
        raise ValueError("categoryid must be present and unique")
    tree.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def load_item_properties(spark: SparkSession, paths: list[str], target: str) -> int:
    """Replace the item property table with every part; returns its row count."""
    properties = read_item_properties(spark, paths)
    long_name = F.length("property") > S.PROPERTY_CHARS
    if properties.where(F.col("itemid").isNull() | long_name).limit(1).count():
        raise ValueError(f"itemid must be present and property at most {S.PROPERTY_CHARS} characters long")
    properties.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()
