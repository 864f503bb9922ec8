import pytest
from pyspark.sql import functions as F

from clicktide.sources.tables import newest_in_files


def test_newest_from_footers(spark, tmp_path):
    df = spark.range(1000).select(
        "id", F.timestamp_millis(F.lit(1_700_000_000_999) + F.col("id") * 1000).alias("at"),
        F.timestamp_micros(F.lit(1_700_000_000_999_999) + F.col("id")).cast("timestamp_ntz").alias("zoneless"),
        F.lit(None).cast("long").alias("nothing"), F.when(F.col("id") < 10, F.col("id")).alias("some"), F.lit("x").alias("word"),
    )
    path = str(tmp_path / "t")
    df.repartition(5).write.option("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS").parquet(path)
    df.limit(0).write.mode("append").parquet(path)
    want = {"id": 999, "at": 1_700_000_999_999, "zoneless": 1_700_000_001_000, "nothing": None, "some": 9}
    assert {c: newest_in_files(spark, path, c) for c in want} == want


def test_files_without_statistics_are_scanned(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "t").mkdir()
    for name, stats, top in (("a", True, 5), ("b", False, 9), ("c", False, 7)):
        pq.write_table(pa.table({"v": pa.array(range(top + 1), pa.int64())}), tmp_path / "t" / f"{name}.parquet", write_statistics=stats)
    assert newest_in_files(spark, str(tmp_path / "t"), "v") == 9


def test_no_data_page_is_read(spark, tmp_path):
    """The data pages are overwritten; the footer still tells."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    place = tmp_path / "t"
    place.mkdir()
    pq.write_table(pa.table({"v": pa.array(range(100_000), pa.int64())}), place / "a.parquet")
    footer = pq.ParquetFile(place / "a.parquet").metadata.serialized_size
    raw = bytearray((place / "a.parquet").read_bytes())
    raw[4 : len(raw) - footer - 8] = bytes(len(raw) - footer - 12)
    (place / "a.parquet").write_bytes(raw)
    assert newest_in_files(spark, str(place), "v") == 99_999
    with pytest.raises(Exception):
        spark.read.parquet(str(place)).selectExpr("sum(v)").collect()
