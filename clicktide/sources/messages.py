"""JSON event messages: encoding, parsing and dead letters."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktide import schema as S
from clicktide.functions.columns import add_once, event_time, transaction_text

_CORRUPT = "_corrupt_record"


def read_stream(spark: SparkSession, source: str, **options) -> DataFrame:
    """A stream with a ``value`` column.

    ``kafka``: pass ``servers`` and ``topic`` (and any Kafka option, such as
    ``maxOffsetsPerTrigger``).  Starts at the latest offsets unless told otherwise.
    ``files``: pass ``path``; one JSON message per line.
    """
    if source == "kafka":
        settings = {
            "kafka.bootstrap.servers": options.pop("servers"),
            "subscribe": options.pop("topic"),
            "startingOffsets": "latest",
        }
        return spark.readStream.format("kafka").options(**{**settings, **options}).load()
    if source == "files":
        path = options.pop("path")
        return spark.readStream.format("text").options(**options).load(path)
    raise ValueError(f"unknown stream source {source!r}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float column becomes NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def to_messages(df: DataFrame, key: str = "visitorid") -> DataFrame:
    """(key, value): rows as JSON, keyed so that a visitor keeps its order.

    NULL stays an explicit ``null``.  Without the key column, or where it is
    NULL, a number that is unique within the job takes its place.
    """
    clean = nan_to_null(df)
    number = F.monotonically_increasing_id().cast("string")
    keyed = F.coalesce(F.col(key).cast("string"), number) if key in df.columns else number
    value = F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"})
    return clean.select(keyed.alias("key"), value.alias("value"))


def write_messages(messages: DataFrame, servers: str, topic: str) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def parse_events(df: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split messages into (valid, invalid).

    A message is valid when it is one JSON object and nothing else, matches the
    schema, the columns that may not be empty are present and its timestamp is an
    instant of the years 1 to 9999.  ``from_json`` yields a struct of NULLs for
    malformed text, so a NULL test on the struct alone would let it through.
    Transaction ids stay text.  Every message is in exactly one of the two frames.
    """
    parsed, good = _parsed(df, value_col)
    valid = (
        parsed.where(good)
        .select(*S.EVENT_MESSAGE.names)
        .withColumn("transactionid", transaction_text())
        .withColumn("event_time", event_time())
    )
    return valid, parsed.where(~good).select("raw_message")


def parsed_messages(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Every message in one frame: ``raw_message, valid``, the fields and ``event_time``.

    For writers that use both kinds of a batch and parse it once; ``valid`` is that of
    :func:`parse_events`, and the fields of messages that are not are NULL.
    """
    parsed, good = _parsed(df, value_col)
    fields = [F.when(F.col("valid"), F.col(c)).alias(c) for c in S.EVENT_MESSAGE.names]
    told = parsed.withColumn("valid", good).select("raw_message", "valid", *fields)
    return told.withColumn("transactionid", transaction_text()).withColumn("event_time", event_time())


def _parsed(df, value_col):
    schema = T.StructType([*S.EVENT_MESSAGE.fields, T.StructField(_CORRUPT, T.StringType())])
    messages = df.select(F.col(value_col).cast("string").alias("raw_message"))
    data = F.from_json("raw_message", schema, {"columnNameOfCorruptRecord": _CORRUPT})
    parsed = add_once(messages, data)
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in S.REQUIRED_EVENT_COLUMNS])
    dated = F.col("timestamp").between(S.EARLIEST_MS, S.LATEST_MS)
    good = F.coalesce(present & dated & F.col(_CORRUPT).isNull() & _one_value("raw_message"), F.lit(False))
    return parsed, good


def _one_value(text: str):
    """Whether a text is one JSON value with nothing after it.

    ``from_json`` stops reading at the end of the first value.  As an element of
    an array the text has to be followed by what comes next; a text that closes
    the array itself has the same length in both.
    """
    alone = F.json_array_length(F.concat(F.lit("["), F.col(text), F.lit("]"))) == 1
    followed = F.json_array_length(F.concat(F.lit("["), F.col(text), F.lit(",0]"))) == 2
    return alone & followed


def dead_letter(invalid: DataFrame, reason: str = S.PARSE_FAILURE) -> DataFrame:
    """Audit columns for messages that could not be parsed."""
    return invalid.select(
        "raw_message",
        F.lit(reason).alias("error_message"),
        F.current_timestamp().alias("error_timestamp"),
    )


def failed_batch(batch: DataFrame, batch_id: int, reason: str) -> DataFrame:
    """All rows of a micro-batch that could not be stored, with the reason."""
    return (
        batch.withColumn("error_message", F.lit(reason))
        .withColumn("error_timestamp", F.current_timestamp())
        .withColumn("batch_id", F.lit(batch_id).cast("long"))
    )


def as_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON ``value``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
