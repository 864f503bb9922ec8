"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import materialize


def _state(edges: DataFrame):
    """Number and an order-free checksum of the edges."""
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge with the smallest neighbour of ``u``; the minimum is combined in the tasks first."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``u, v``): the smallest node reachable.

    Alternates large and small stars until nothing changes, so the rounds grow
    with the logarithm of the size of a component, and no component is ever
    gathered in one place.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _with_least(large)  # here v < u always
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        edges = materialize(small.where("u <> v").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
