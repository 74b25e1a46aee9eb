"""Due, overdue and stale lists, and the dashboard.

All take ``as_of`` as the present. A filter that is ``None`` is left out, so
the others still reach the scan. The lists are sorted, or with ``rank`` carry
their order as a column, which a writer or a join does not lose.
"""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowspark.functions import labels
from knowspark.functions.times import days_since, instant, instant_for, to_iso
from knowspark.operators.ranks import in_order
from knowspark.sources.store import Store

# --- Fixed values: day windows of the dashboard ---
DUE_SOON_DAYS = 7
REACH_OUT_DAYS = 14
# --- end of fixed values ---


def _plus(as_of, days):
    return instant(as_of) + dt.timedelta(days=days)


def _view(df: DataFrame) -> DataFrame:
    return df.drop("embedding")


def list_tasks(
        store: Store, as_of, status: str = None, category: str = None,
        due_soon_days: int = None, rank: bool = False) -> DataFrame:
    """Tasks by priority, due date, newest; the due window has no lower bound."""
    df = _view(store.tasks)
    if status is not None:
        df = df.filter(F.col("status") == status)
    if category is not None:
        df = df.filter(F.col("category") == category)
    if due_soon_days is not None:
        limit = instant_for(df, "due_date", _plus(as_of, due_soon_days))
        df = df.filter(F.col("due_date") <= limit)
    return in_order(
        df, labels.priority_rank("priority"), F.asc_nulls_last("due_date"), F.desc("created_at"), "id",
        rank=rank)


def list_contacts(
        store: Store, as_of, reach_out_days: int = None, rank: bool = False) -> DataFrame:
    """Contacts, never contacted first, then longest ago."""
    df = _view(store.contacts)
    if reach_out_days is not None:
        df = df.filter(_not_since(df, as_of, reach_out_days))
    return in_order(df, F.asc_nulls_first("last_contact_at"), "name", "id", rank=rank)


def list_home_items(
        store: Store, as_of, due_soon_days: int = None, rank: bool = False) -> DataFrame:
    df = _view(store.home_items)
    if due_soon_days is not None:
        df = df.filter(
            F.col("next_due_at") <= instant_for(df, "next_due_at", _plus(as_of, due_soon_days)))
    return in_order(df, F.asc_nulls_last("next_due_at"), "name", "id", rank=rank)


def _not_since(contacts: DataFrame, as_of, days: int):
    limit = instant_for(contacts, "last_contact_at", _plus(as_of, -days))
    return F.col("last_contact_at").isNull() | (F.col("last_contact_at") < limit)


def overdue_tasks(store: Store, as_of) -> DataFrame:
    df = _view(store.tasks)
    return df.filter(
        (F.col("status") == "open") & (F.col("due_date") < instant_for(df, "due_date", as_of))
    ).orderBy("due_date", "id")


def due_soon_tasks(store: Store, as_of, days: int = DUE_SOON_DAYS) -> DataFrame:
    df = _view(store.tasks)
    return df.filter(
        (F.col("status") == "open")
        & F.col("due_date").between(
            instant_for(df, "due_date", as_of), instant_for(df, "due_date", _plus(as_of, days)))
    ).orderBy("due_date", "id")


def overdue_home(store: Store, as_of) -> DataFrame:
    df = _view(store.home_items)
    return df.filter(F.col("next_due_at") < instant_for(df, "next_due_at", as_of)) \
        .orderBy("next_due_at", "id")


def due_soon_home(store: Store, as_of, days: int = DUE_SOON_DAYS) -> DataFrame:
    df = _view(store.home_items)
    return df.filter(F.col("next_due_at").between(
        instant_for(df, "next_due_at", as_of), instant_for(df, "next_due_at", _plus(as_of, days)))
    ).orderBy("next_due_at", "id")


def contacts_to_reach(store: Store, as_of, days: int = REACH_OUT_DAYS) -> DataFrame:
    """Never contacted, or strictly longer ago than ``days``."""
    df = _view(store.contacts)
    return df.filter(_not_since(df, as_of, days)).orderBy(
        F.asc_nulls_first("last_contact_at"), "id")


def stale_contacts_days(store: Store, as_of, days: int = labels.STALE_DAYS) -> DataFrame:
    """The browser's variant: whole days, exactly ``days`` included."""
    return _view(store.contacts).filter(labels.is_stale("last_contact_at", as_of, days)) \
        .withColumn("days", days_since("last_contact_at", as_of))


def contacts_by_name(store: Store, q: str) -> DataFrame:
    """Name contains the text, ignoring case; blank text keeps all."""
    q = (q or "").strip().lower()
    df = _view(store.contacts)
    return df.filter(F.lower("name").contains(q)) if q else df


def dashboard(store: Store, as_of) -> dict:
    """The five sections as separate DataFrames."""
    return {
        "overdue_tasks": overdue_tasks(store, as_of),
        "due_soon_tasks": due_soon_tasks(store, as_of),
        "overdue_home": overdue_home(store, as_of),
        "due_soon_home": due_soon_home(store, as_of),
        "contacts_to_reach": contacts_to_reach(store, as_of),
    }


def dashboard_rows(store: Store, as_of) -> DataFrame:
    """All sections as rows ``(section, id, title, sort_key)``; each table is
    scanned once, the section follows from the due date."""
    tasks, home = store.tasks, store.home_items
    task_rows = (
        tasks.filter(
            (F.col("status") == "open")
            & (F.col("due_date") <= instant_for(tasks, "due_date", _plus(as_of, DUE_SOON_DAYS))))
        .select(
            F.when(F.col("due_date") < instant_for(tasks, "due_date", as_of), "overdue_tasks")
            .otherwise("due_soon_tasks").alias("section"),
            "id", "title", F.col("due_date").cast("string").alias("sort_key"))
    )
    home_rows = (
        home.filter(F.col("next_due_at")
                    <= instant_for(home, "next_due_at", _plus(as_of, DUE_SOON_DAYS)))
        .select(
            F.when(F.col("next_due_at") < instant_for(home, "next_due_at", as_of), "overdue_home")
            .otherwise("due_soon_home").alias("section"),
            "id", F.col("name").alias("title"), to_iso("next_due_at").alias("sort_key"))
    )
    contact_rows = (
        store.contacts.filter(_not_since(store.contacts, as_of, REACH_OUT_DAYS))
        .select(F.lit("contacts_to_reach").alias("section"), "id",
                F.col("name").alias("title"), to_iso("last_contact_at").alias("sort_key"))
    )
    return task_rows.unionByName(home_rows).unionByName(contact_rows)
