"""Display labels of the pages as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from knowspark.functions.times import DAY_MICROS, age_micros, days_since, instant

# --- Fixed values: day limits and texts of the pages ---
STALE_DAYS = 14
DUE_SOON_DAYS = 7
JUST_NOW = "just now"
MINUTES, HOURS, DAYS, MONTHS = "m", "h", "d", "mo"
DAYS_AGO, DAYS_OVERDUE = "d ago", "d overdue"
TODAY, TOMORROW, IN = "today", "tomorrow", "in "
DUE_TODAY, DUE_IN, NO_DUE = "due today", "due in ", "—"
NEVER_CONTACTED = "never contacted"
CLASS_OVERDUE, CLASS_DUE_SOON = "overdue", "due-soon"
DETAIL_SEPARATOR = " · "
LINE_TIME, LINE_SEPARATOR = "yyyy-MM-dd HH:mm 'UTC'", ": "
# --- end of fixed values ---


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _text(number) -> Column:
    return number.cast("string")


def rel_time(ts, as_of, months: bool = False) -> Column:
    """``just now``, ``5m``, ``3h``, ``12d`` and, with ``months``, ``2mo``."""
    minutes = F.floor(age_micros(ts, as_of) / F.lit(60_000_000.0))
    hours = F.floor(minutes / F.lit(60))
    days = F.floor(hours / F.lit(24))
    label = (
        F.when(minutes < 1, JUST_NOW)
        .when(minutes < 60, F.concat(_text(minutes), F.lit(MINUTES)))
        .when(hours < 24, F.concat(_text(hours), F.lit(HOURS)))
    )
    if months:
        label = label.when(days < 30, F.concat(_text(days), F.lit(DAYS))).when(
            days >= 30, F.concat(_text(F.floor(days / F.lit(30))), F.lit(MONTHS)))
    else:
        label = label.when(days >= 1, F.concat(_text(days), F.lit(DAYS)))
    return label


def task_due_label(due_date, as_of) -> Column:
    """``3d overdue``, ``today``, ``tomorrow``, ``in 5d``; empty without a date."""
    today = F.lit(instant(as_of).date().isoformat()).cast("date")
    diff = F.datediff(_c(due_date), today)
    return (
        F.when(diff.isNull(), "")
        .when(diff < 0, F.concat(_text(F.abs(diff)), F.lit(DAYS_OVERDUE)))
        .when(diff == 0, TODAY)
        .when(diff == 1, TOMORROW)
        .otherwise(F.concat(F.lit(IN), _text(diff), F.lit(DAYS)))
    )


def is_overdue(due_date, status, as_of) -> Column:
    today = F.lit(instant(as_of).date().isoformat()).cast("date")
    return F.coalesce((_c(due_date) < today) & (_c(status) == "open"), F.lit(False))


def _days_until(ts, as_of) -> Column:
    return F.ceil(-age_micros(ts, as_of) / F.lit(float(DAY_MICROS)))


def home_due_label(next_due_at, as_of) -> Column:
    days = _days_until(next_due_at, as_of)
    return (
        F.when(days.isNull(), NO_DUE)
        .when(days < 0, F.concat(_text(F.abs(days)), F.lit(DAYS_OVERDUE)))
        .when(days == 0, DUE_TODAY)
        .otherwise(F.concat(F.lit(DUE_IN), _text(days), F.lit(DAYS)))
    )


def home_due_class(next_due_at, as_of) -> Column:
    days = _days_until(next_due_at, as_of)
    return (
        F.when(days < 0, CLASS_OVERDUE)
        .when(days <= DUE_SOON_DAYS, CLASS_DUE_SOON)
        .otherwise("")
    )


def last_contact_label(ts, as_of) -> Column:
    days = days_since(ts, as_of)
    return (
        F.when(days.isNull(), NEVER_CONTACTED)
        .when(days == 0, TODAY)
        .otherwise(F.concat(_text(days), F.lit(DAYS_AGO)))
    )


def is_stale(ts, as_of, days: int = STALE_DAYS) -> Column:
    """Never contacted, or at least ``days`` whole days ago."""
    return _c(ts).isNull() | (days_since(ts, as_of) >= days)


def initials(name) -> Column:
    heads = F.transform(F.slice(F.split(_c(name), " "), 1, 2), lambda w: F.substring(w, 1, 1))
    return F.upper(F.array_join(heads, ""))


def contact_details(email, phone, company, separator: str = DETAIL_SEPARATOR) -> Column:
    parts = F.array(_c(email), _c(phone), _c(company))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), separator)


def display_text(title, content) -> Column:
    return F.coalesce(F.nullif(_c(title), F.lit("")), _c(content), F.lit(""))


def similarity_pct(similarity) -> Column:
    """Percent, halves rounded up."""
    return F.floor(_c(similarity) * F.lit(100.0) + F.lit(0.5)).cast("long")


def priority_rank(priority) -> Column:
    return F.when(_c(priority) == "high", 0).when(_c(priority) == "medium", 1).otherwise(2)


def interaction_line(ts, note) -> Column:
    return F.concat(F.date_format(_c(ts), LINE_TIME), F.lit(LINE_SEPARATOR), _c(note))
