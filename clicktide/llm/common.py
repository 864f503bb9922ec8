"""Small helpers shared by the corpus operators."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktide.plans.scratch import materialize, new_path

__all__ = ["by_ids", "documents", "materialize", "new_path", "shuffle_partitions", "table", "with_new_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, others: bool = False) -> DataFrame:
    """``doc_id`` and ``text`` alone, with a null text as the empty one.

    With ``others`` the remaining columns come along in one struct of that name,
    whatever they are called.
    """
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
        *([F.struct(*rest, F.lit(None).cast("int").alias("")).alias("others")] if others else []),
    )


def with_new_text(changed: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """Rows of ``documents(others=True)`` as a table of ``columns`` again; ``n_chars`` follows the text."""
    new = {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.length(text).cast("long")}
    return changed.select(*[new.get(c, F.col("others").getField(c)).alias(c) for c in columns])


SENT_IDS = 2_000_000  # ids sent to all tasks (16 MB) rather than joined by a shuffle


def by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a table of ``doc_id``, sent to all tasks if it is counted to be small."""
    return df.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", how)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # in a pure ASCII text lower() does just that, and is much faster
    pure = F.length(text) == F.octet_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, upper, lower))
