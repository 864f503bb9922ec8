"""The registered queries of the corpus operators and the SQL that checks them."""

import public_tokenizers
from pyspark.sql import functions as F

from clicktide.llm import (
    centroids,
    collocations,
    fingerprints,
    inner_product,
    jaccard_join,
    line_dedup,
    packing,
    pieces,
    positional_index,
    surrogates,
    token_blocks,
    toxicity,
    warc,
)
from clicktide.llm.common import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SURROGATE_KEY = "a key for tests; use a secret one"
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_blocks(spark, sf_dir):
    shards = token_blocks.write_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2)
    return token_blocks.read_tokens(shards, with_ids=False)


def op2_inner_product(spark, sf_dir):
    found = inner_product.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # the table has no time of capture: a page a second from a fixed day on
    archives = warc.write_archives(pages, F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")))
    return warc.capture_index(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "slice", "position"
    )


def op4_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), least_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_surrogates(spark, sf_dir):
    return surrogates.replace_personal_data(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op6_pieces(spark, sf_dir):
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), PIECE_TOKENIZER, outputs=False)


def op7_packing(spark, sf_dir):
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=1, window=2048, with_ids=False
    )


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=5, num=80, den=100)


def op10_fingerprints(spark, sf_dir):
    compared = fingerprints.compare_with_edit(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )


def op11_positional_index(spark, sf_dir):
    found = positional_index.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_ns_bounds(spark, sf_dir):
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return centroids.with_inertia(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), order, k=16, rounds=3))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


QUERIES = {
    query.__name__: query
    for query in (
        op1_token_blocks, op2_inner_product, op3_warc, op4_line_dedup, op5_surrogates, op6_pieces, op7_packing,
        op8_toxicity, op9_jaccard_join, op10_fingerprints, op11_positional_index, op12_ns_bounds, op13_collocations,
    )
}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op11_positional_index": positional_index.ORACLE,
    "op12_ns_bounds": centroids.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
