"""Table and message schemas, and the values every job has to agree on."""

from pyspark.sql import types as T

# A message as it travels through the topic.  Ids arrive as JSON numbers; the
# transaction id arrives as text because some producers send it as a float.
EVENT_MESSAGE = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("visitorid", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("itemid", T.LongType()),
        T.StructField("transactionid", T.StringType()),
    ]
)

# The stored click table: the message plus the row id that breaks every tie.
CLICKS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("visitorid", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("itemid", T.LongType()),
        T.StructField("transactionid", T.LongType()),
    ]
)

# Instants from year 1 to year 9999; any other timestamp cannot be stored or shown.
EARLIEST_MS, LATEST_MS = -62_135_596_800_000, 253_402_300_799_999

# Columns a stored event may not leave empty.
REQUIRED_EVENT_COLUMNS = ("timestamp", "visitorid", "event", "itemid")

EVENTS_CSV = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("visitorid", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("itemid", T.LongType()),
        T.StructField("transactionid", T.DoubleType()),
    ]
)

CATEGORY_TREE = T.StructType(
    [
        T.StructField("categoryid", T.IntegerType()),
        T.StructField("parentid", T.IntegerType()),
    ]
)

ITEM_PROPERTIES = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("itemid", T.LongType()),
        T.StructField("property", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

PROPERTY_CHARS = 100

ERROR_EVENTS = T.StructType(
    [
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("error_timestamp", T.TimestampType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("resolved_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

FAILED_MESSAGES = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("partition_key", T.StringType()),
        T.StructField("message", EVENT_MESSAGE),
        T.StructField("raw_message", T.StringType()),
        T.StructField(
            "error",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("message", T.StringType()),
                    T.StructField("traceback", T.StringType()),
                ]
            ),
        ),
    ]
)

# --- fixed values -----------------------------------------------------------
# These have to equal what existing dashboards, tables and models already use.

# event vocabulary and its implicit-feedback weights
EVENT_WEIGHTS = {"view": 1, "addtocart": 2, "transaction": 3}
EVENT_TYPES = ("view", "addtocart", "transaction")

# streaming statistics
WINDOW_SIZE = "5 minutes"
WINDOW_SLIDE = "1 minute"
WATERMARK = "10 minutes"
WINDOW_SIZE_MS = 300_000
WINDOW_SLIDE_MS = 60_000

# training defaults
MIN_EVENTS_PER_USER = 3
TEST_SIZE = 0.2
SEQUENCE_LENGTH = 10
TOP_N = 10

# error handling
ERROR_MESSAGE_CHARS = 1000
ALERT_MESSAGE_CHARS = 500
ERROR_CLASSES = (
    (("json", "parse"), "json_parse", "INFO"),
    (("connection", "connect"), "db_connection", "CRITICAL"),
    (("timeout",), "timeout", "WARNING"),
    (("constraint", "duplicate"), "constraint_violation", "ERROR"),
)
UNKNOWN_ERROR = ("unknown", "ERROR")
ALERT_COLORS = {"CRITICAL": "danger", "ERROR": "warning"}
ALERT_EMOJI = {"CRITICAL": ":rotating_light:", "ERROR": ":warning:"}
ALERT_USERNAME = "E-commerce Spark Error Alert"
ALERT_FOOTER = "Spark Streaming Consumer"
PARSE_FAILURE = "JSON parsing failed"

# health report row labels: raw events, windowed statistics, event statistics
HEALTH_LABELS = ("원본 이벤트", "윈도우 통계", "이벤트 통계")

# virtual category names, picked by item id modulo their number
CATEGORY_NAMES = (
    "스마트폰", "노트북", "태블릿", "이어폰", "스마트워치",
    "카메라", "의류", "신발", "가방", "시계",
    "안경", "화장품", "식품", "가전", "가구",
    "책", "완구", "스포츠", "악기", "자동차",
)
