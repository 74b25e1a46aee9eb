"""Instants given as parameters, and differences between instants.

The caller passes ``as_of``. Only ``ingest`` without one, and the streams, read the clock.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MICROS = 86_400_000_000


def instant(value) -> dt.datetime:
    """A naive UTC datetime from a datetime, a date or an ISO string (Z allowed)."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return dt.datetime(value.year, value.month, value.day)


def instant_lit(value, dtype: T.DataType) -> Column:
    """A literal of the given column type, so that comparisons need no cast of
    the column and still reach the Parquet scan."""
    text = instant(value).isoformat(sep=" ")
    if isinstance(dtype, T.DateType):
        text = text[:10]
    elif isinstance(dtype, T.TimestampType):
        text += "+00:00"
    return F.lit(text).cast(dtype)


def instant_for(df: DataFrame, column: str, value) -> Column:
    return instant_lit(value, df.schema[column].dataType)


def micros(column) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str)
                         else column.cast("timestamp"))


def micros_of(value) -> int:
    return round((instant(value) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def age_micros(column, as_of) -> Column:
    """Microseconds from the column's instant to ``as_of``."""
    return F.lit(micros_of(as_of)).cast("long") - micros(column)


def days_since(column, as_of) -> Column:
    """Whole days passed, rounded down; NULL stays NULL."""
    return F.floor(age_micros(column, as_of) / F.lit(float(DAY_MICROS)))


def to_iso(column) -> Column:
    """ISO text of an instant in UTC; the fraction appears only when non-zero."""
    shown = (F.col(column) if isinstance(column, str) else column).cast("string")
    fraction = F.substring(shown, 20, 7)
    return F.concat(
        F.translate(F.substring(shown, 1, 19), " ", "T"),
        F.when(fraction == "", "").otherwise(F.rpad(fraction, 7, "0")),
        F.lit("+00:00"),
    )


def parse_iso(column) -> Column:
    """Timestamp of ISO text; a trailing Z means UTC."""
    return F.to_timestamp(F.col(column) if isinstance(column, str) else column)
