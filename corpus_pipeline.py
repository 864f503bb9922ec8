"""The corpus pipeline: from raw documents to packed training sequences.

Every stage works on all documents its predecessor kept and is written as
Parquet before the next one reads it.  Stages but the last return the columns of
``documents``; clean documents stay, and where a text changes ``n_chars`` follows.
"""

from pyspark.sql import functions as F

from clicktide.llm import jaccard_join, line_dedup, packing, queries, surrogates, toxicity
from clicktide.llm.common import by_ids, materialize, table, with_new_text

BATCH_BYTES = 4 << 20  # texts go to Python workers in batches of this size, or of one row


def small_batches(spark):
    """Cut Arrow batches by bytes, from now on in this session.

    The default cuts at 10 000 rows or 64 MB.  An executor holds a batch per task
    twice, and also what earlier stages left in its heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark, docs, sf_dir):
    """Without documents of a toxicity score of 0.3 or more."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, threshold=0.3, whole_rows=True)
    return scored.where("predicted = 0").select("row.*")


def drop_repeated_lines(spark, docs, sf_dir):
    """Without lines that a document of a smaller id has; every document stays, even if empty."""
    kept = line_dedup.dedup_lines(docs, least_chars=10, others=True)
    return with_new_text(kept, docs.columns, "kept")


def _numbered_rows(docs):
    """Rows with a number each as ``doc_id``, by their own id (none: last) and text; that id is ``_given_id``."""
    rows = docs.withColumnRenamed("doc_id", "_given_id").withColumn("doc_id", F.monotonically_increasing_id())
    order = [F.col("_given_id").asc_nulls_last(), F.col("_hash").asc(), F.col("doc_id").asc()]
    ranged = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.drop("_hash").withColumn("doc_id", F.monotonically_increasing_id()), "numbered-rows")


def keep_one_of_each(spark, docs, sf_dir):
    """One row of every group of near duplicates: that of the smallest ``doc_id``, before rows without one.

    Every row is a document of its own, also without an id or with one that other
    rows have; among rows of one id the smallest hash of the text stays.
    """
    small_batches(spark)
    shared = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    own = shared.isEmpty()
    rows = docs if own else _numbered_rows(docs)
    found = jaccard_join.near_duplicates(rows, words=5, num=80, den=100)
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    kept = by_ids(rows, gone, "left_anti")
    return kept.select(*[c if own or c != "doc_id" else F.col("_given_id").alias(c) for c in docs.columns])


def replace_personal_data(spark, docs, sf_dir):
    """Personal data replaced by surrogates."""
    replaced = surrogates.replace_personal_data(docs, queries.SURROGATE_KEY, others=True)
    return with_new_text(replaced, docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of packed sequences of 2048 tokens, with their ids."""
    small_batches(spark)
    return packing.pack_documents(docs, queries.WORD_TOKENIZER, end_id=1, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

# trees, tokenizers and keyed surrogates are not SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
