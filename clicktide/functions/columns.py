"""Column expressions shared by the operators.  All of them stay in the JVM."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide import schema as S


def add_once(df: DataFrame, value: Column, name: str | None = None) -> DataFrame:
    """Add a costly value, computed one time per row.

    The optimizer copies an expression into every filter that uses it.  It does
    not look through a generator, so a one-element one keeps it in one place.
    Without a name, ``value`` is a struct whose fields become columns.
    """
    one = F.array(value)
    return df.select("*", F.explode(one).alias(name) if name else F.inline(one))


def event_time(ms="timestamp") -> Column:
    """Epoch milliseconds as an instant, milliseconds kept."""
    return F.timestamp_millis(F.col(ms))


def event_second(ms="timestamp") -> Column:
    """Epoch milliseconds as an instant cut to whole seconds."""
    return F.timestamp_seconds(F.expr(f"`{ms}` div 1000"))


def ntz(col) -> Column:
    """A zoneless timestamp; the session runs in UTC (see ``plans.session``)."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def count_event(name: str) -> Column:
    return F.count_if(F.col("event") == name)


def stage_counts(views="views", carts="addtocarts", purchases="purchases") -> list[Column]:
    """One conditional count per funnel stage."""
    return [
        count_event(event).alias(name)
        for event, name in zip(S.EVENT_TYPES, (views, carts, purchases))
    ]


def percent(part, whole) -> Column:
    """Percentage of two counts with two decimals; NULL when the whole is zero.

    Rounds halves up in whole numbers, since a double such as 5.015 lies a
    little below the half it stands for.
    """
    part, whole = _col(part).cast("long"), _col(whole).cast("long")
    doubled = F.nullif(2 * whole, F.lit(0).cast("long"))
    return F.call_function("div", 20_000 * part + whole, doubled) / F.lit(100.0)


def percent_or_zero(part, whole) -> Column:
    return F.coalesce(percent(part, whole), F.lit(0.0))


def fraction_or_zero(part, whole) -> Column:
    return F.coalesce(
        F.try_divide(_col(part).cast("double"), _col(whole).cast("double")), F.lit(0.0)
    )


def known_event(event="event") -> Column:
    return F.col(event).isin(*S.EVENT_TYPES)


def event_weight(event="event") -> Column:
    """Implicit-feedback weight; NULL for events outside the vocabulary."""
    weight = F
    for name, value in S.EVENT_WEIGHTS.items():
        weight = weight.when(F.col(event) == name, F.lit(value).cast("long"))
    return weight


def category_name(item="itemid", names=S.CATEGORY_NAMES) -> Column:
    slot = F.pmod(F.col(item), F.lit(len(names))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(n) for n in names]), slot)


def transaction_text(text="transactionid") -> Column:
    """A whole number written as a float loses its zeros; any other text stays."""
    return F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1")


def transaction_number(text="transactionid") -> Column:
    """``"4000"`` and ``"4000.0"`` both become 4000; what is no whole number becomes NULL."""
    plain = transaction_text(text)
    return F.when(plain.rlike("^-?[0-9]+$"), plain.try_cast("bigint"))


def error_class(lowered: str) -> Column:
    """Struct (error_type, severity) of the first class whose words occur in a
    message that is already in lower case."""
    text = F.col(lowered)
    verdict = F
    for words, kind, severity in S.ERROR_CLASSES:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        verdict = verdict.when(hit, _class(kind, severity))
    return verdict.otherwise(_class(*S.UNKNOWN_ERROR))


def _class(kind, severity):
    return F.struct(F.lit(kind).alias("error_type"), F.lit(severity).alias("severity"))


def _col(c):
    return F.col(c) if isinstance(c, str) else c
