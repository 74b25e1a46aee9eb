"""Batch forms of update, delete, complete and log.

Each takes a table and a DataFrame of changes and returns the table's next
state, to be written as a new snapshot.
"""

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowspark import schema
from knowspark.functions import labels
from knowspark.functions.text import embed_text, stable_uuid
from knowspark.functions.times import instant_for
from knowspark.operators.ingest import embedding_of
from knowspark.operators.notes import ordered_concat
from knowspark.operators.ranks import numbered
from knowspark.operators.reduced import anti_join


def _any(conditions: list) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def reduce_changes(changes: DataFrame, table: str, version: str) -> DataFrame:
    """One row per id: of each column the last value that is not NULL.

    That is what applying the changes one after another gives; versions are unique
    per id. Only numbers are aggregated over all changes: per id and column the
    last version that gives a value, by hash and before the shuffle. The values
    are then fetched by (id, version), so an id with very many changes is no hot
    spot, and one small list per id is left to pick from.
    """
    columns = [c for c in changes.columns if c not in ("id", version)]
    unknown = sorted(set(columns) - set(schema.UPDATABLE[table]))
    if unknown:
        raise ValueError(f"columns {unknown} of {table} cannot be updated")
    last = changes.groupBy("id").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.col(version))).alias(f"_at_{c}") for c in columns])
    wanted = last.withColumn("_version", F.explode_outer(F.array_distinct(
        F.array(*[f"_at_{c}" for c in columns]))))
    values = changes.select(F.col("id").alias("_id"), F.col(version).alias("_given"), *columns)
    found = wanted.join(values, (F.col("id") == F.col("_id")) & (F.col("_version") == F.col("_given")),
                        "left")
    rows = found.groupBy("id").agg(F.collect_list(F.struct(
        "_version", *[f"_at_{c}" for c in columns], *columns)).alias("_rows"))

    def chosen(c):
        own = F.filter("_rows", lambda r: r["_version"] == r[f"_at_{c}"])
        return F.get(own, 0)[c].alias(f"_new_{c}")

    return rows.select("id", *[chosen(c) for c in columns])


def _merged(df: DataFrame, column: str) -> Column:
    new = f"_new_{column}"
    return F.coalesce(F.col(new), F.col(column)) if new in df.columns else F.col(column)


def _apply(joined: DataFrame, table: str, as_of, make_embedder, with_text: bool = False):
    columns = [c for c in joined.columns if not c.startswith("_new_")]
    changed = [c for c in columns if f"_new_{c}" in joined.columns]
    touched = _any([F.col(f"_new_{c}").isNotNull() for c in changed])
    values = {c: _merged(joined, c).cast(joined.schema[c].dataType) for c in changed}
    text_columns = schema.EMBEDDED_TEXT[table]
    text_changed = [F.col(f"_new_{c}").isNotNull() for c in text_columns if c in changed]
    if text_changed and (make_embedder is not None or with_text):
        text = F.when(_any(text_changed), embed_text(*[_merged(joined, c) for c in text_columns]))
        if with_text:
            values["_text"] = text
    if "updated_at" in columns:
        values["updated_at"] = F.when(
            touched, instant_for(joined, "updated_at", as_of)).otherwise(F.col("updated_at"))
    keep = [c for c in columns if c not in values]

    def state(rows, values):
        return rows.select(*[c for c in keep if c not in values],
                           *[v.alias(c) for c, v in values.items()], touched.alias("_touched"))

    if not text_changed or make_embedder is None:
        return state(joined, values)
    # Only rows whose text is given pass through the model.
    given = F.coalesce(_any(text_changed), F.lit(False))
    vector = {"embedding": F.coalesce(embedding_of(text, make_embedder), F.col("embedding"))}
    return state(joined.filter(given), values | vector).unionByName(
        state(joined.filter(~given), values))


def apply_updates(table: DataFrame, changes: DataFrame, name: str, as_of,
                  version: str = "version",
                  make_embedder: Callable = None) -> DataFrame:
    """The table after all changes.

    NULL keeps a value, unknown ids are ignored, ``updated_at`` moves only on
    rows that got a value. With an embedder, rows whose text columns are given
    are embedded again from their merged text.
    """
    joined = table.join(reduce_changes(changes, name, version), "id", "left")
    return _apply(joined, name, as_of, make_embedder).drop("_touched").select(*table.columns)


def updated_rows(table: DataFrame, changes: DataFrame, name: str, as_of,
                 version: str = "version", make_embedder: Callable = None) -> DataFrame:
    """Only the rows that change, in their new form: what an append-only table
    stores instead of a whole new snapshot."""
    joined = table.join(reduce_changes(changes, name, version), "id")
    return _apply(joined, name, as_of, make_embedder).filter("_touched") \
        .select(*table.columns)


def needs_reembed(table: DataFrame, changes: DataFrame, name: str,
                  version: str = "version") -> DataFrame:
    """Ids whose embedded text is given anew, with the merged text."""
    joined = table.join(reduce_changes(changes, name, version), "id")
    given = [f"_new_{c}" for c in schema.EMBEDDED_TEXT[name] if f"_new_{c}" in joined.columns]
    if not given:
        return joined.limit(0).select("id", F.lit("").alias("text"))
    return joined.filter(_any([F.col(c).isNotNull() for c in given])).select(
        "id", embed_text(*[_merged(joined, c) for c in schema.EMBEDDED_TEXT[name]]).alias("text"))


def update_thoughts(thoughts: DataFrame, changes: DataFrame, as_of, version: str = "version",
                    make_embedder: Callable = None, rechunk: bool = False) -> DataFrame:
    """Updates thoughts by id; chunk rows may be updated too.

    New content replaces that row's content only, its other chunks stay. With
    ``rechunk`` a parent that gets content loses its chunks.
    """
    if rechunk and "content" in changes.columns:
        given = changes.filter(F.col("content").isNotNull()).select(
            F.col("id").alias("parent_id")).distinct()
        # Only chunk rows take part in the join: the NULL parent ids of all other
        # rows would meet in one task.
        heads = thoughts.filter(F.col("parent_id").isNull())
        tails = thoughts.filter(F.col("parent_id").isNotNull())
        thoughts = heads.unionByName(tails.join(given, "parent_id", "left_anti"))
    return apply_updates(thoughts, changes, "thoughts", as_of, version, make_embedder)


def delete_rows(table: DataFrame, ids: DataFrame, reduce: bool = False) -> DataFrame:
    """The table without the ids in the first column of ``ids``, repeats allowed.

    With ``reduce`` a bitmap of the ids keeps nearly all other rows out of the shuffle.
    """
    return _without(table, ids.select(F.col(ids.columns[0]).alias("id")), "id", reduce)


def _without(table: DataFrame, gone: DataFrame, key: str, reduce: bool) -> DataFrame:
    return anti_join(table, gone, key) if reduce else table.join(gone.distinct(), key, "left_anti")


def delete_thoughts(thoughts: DataFrame, ids: DataFrame, reduce: bool = False) -> DataFrame:
    """Deletes parents with all their chunks; the id of a chunk deletes nothing.
    ``reduce`` as in :func:`delete_rows`."""
    gone = ids.select(F.col(ids.columns[0]).alias("_root"))
    keyed = thoughts.withColumn("_root", F.coalesce("parent_id", "id"))
    return _without(keyed, gone, "_root", reduce).select(*thoughts.columns)


def next_tasks(tasks: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """The open copies that completions ``(event_id, id)`` spawn.

    One per event, however often the event is delivered, of tasks with a non-zero recurrence
    and a due date. The copy is due the recurrence after the old due date and
    keeps tags and embedding.
    """
    recurring = tasks.filter(
        (F.col("recurrence_days") != 0) & F.col("due_date").isNotNull())
    once = events.select("event_id", "id").distinct()
    spawned = recurring.join(once, "id")
    values = {
        "id": stable_uuid("event_id", "id", F.lit("next")),
        "status": F.lit("open"),
        "due_date": F.date_add("due_date", F.col("recurrence_days")),
        "created_at": instant_for(tasks, "created_at", as_of),
        "updated_at": instant_for(tasks, "updated_at", as_of),
    }
    return spawned.select(*[
        values.get(c, F.col(c)).alias(c) for c in tasks.columns])


def complete_tasks(tasks: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """The table after completions: tasks done, next occurrences added."""
    done = events.groupBy("id").agg(F.lit(True).alias("_done"))
    joined = tasks.join(done, "id", "left")
    hit = F.col("_done").isNotNull()
    closed = joined.withColumns({
        "status": F.when(hit, "done").otherwise(F.col("status")),
        "updated_at": F.when(hit, instant_for(tasks, "updated_at", as_of))
        .otherwise(F.col("updated_at"))}).select(*tasks.columns)
    return closed.unionByName(next_tasks(tasks, events, as_of))


def complete_home(home_items: DataFrame, events: DataFrame) -> DataFrame:
    """Home items after completions ``(id, ts)``: last done at the latest event,
    next due the interval after it, unchanged without an interval."""
    last = events.groupBy("id").agg(F.max("ts").alias("_ts"))
    joined = home_items.join(last, "id", "left")
    hit = F.col("_ts").isNotNull()
    kind = home_items.schema["next_due_at"].dataType
    due = F.timestamp_add("DAY", F.col("interval_days"), F.col("_ts")).cast(kind)
    return joined.withColumns({
        "next_due_at": F.when(hit & F.col("interval_days").isNotNull(), due)
        .otherwise(F.col("next_due_at")),
        "last_done_at": F.coalesce("_ts", "last_done_at"),
        "updated_at": F.coalesce("_ts", "updated_at")}).select(*home_items.columns)


#: Lines of one contact that are joined in one place at first.
PART_LINES = 256


def numbered_lines(events: DataFrame) -> DataFrame:
    """The line of each interaction, with its place among those of all contacts."""
    lines = events.select(
        F.col("contact_id").alias("id"), "ts", "event_id",
        labels.interaction_line("ts", "note").alias("_lines")).distinct()
    return numbered(lines, "id", "ts", "event_id", "_lines", out="_place")


def log_interactions(contacts: DataFrame, events: DataFrame,
                     make_embedder: Callable = None) -> DataFrame:
    """Contacts after interactions ``(event_id, contact_id, ts, note)``.

    Each becomes a line of the notes in order of time, after a blank line unless
    the notes were empty; the latest is the last contact. An event delivered again
    counts once. Lines are joined in parts of ``PART_LINES`` first, counted and not
    timed, so a contact with very many events, in whatever time, is spread over tasks.
    """
    logged = ordered_concat(
        numbered_lines(events), "id", F.floor(F.col("_place") / PART_LINES), ["_place"],
        "_lines", "\n\n", _last=(F.max, "ts"))
    joined = contacts.join(logged, "id", "left")
    hit = F.col("_last").isNotNull()
    notes = F.when(hit, F.concat_ws(
        "\n\n", F.nullif(F.col("notes"), F.lit("")), F.col("_lines"))).otherwise(F.col("notes"))
    staged = joined.withColumn("notes", notes)
    values = {
        "last_contact_at": F.coalesce("_last", "last_contact_at"),
        "updated_at": F.coalesce("_last", "updated_at"),
    }
    if make_embedder is None:
        return staged.withColumns(values).select(*contacts.columns)
    # Only contacts with new lines pass through the model.
    text = embed_text(*schema.EMBEDDED_TEXT["contacts"])
    vector = {"embedding": F.coalesce(embedding_of(text, make_embedder), F.col("embedding"))}
    return staged.filter(hit).withColumns(values | vector).select(*contacts.columns).unionByName(
        staged.filter(~hit).select(*contacts.columns))


def last_contacts(events: DataFrame) -> DataFrame:
    """Latest interaction and number of them per contact, from event rows alone.
    An event delivered again counts once; both steps combine before the shuffle."""
    once = events.groupBy("contact_id", "event_id").agg(F.max("ts").alias("ts"))
    return once.groupBy("contact_id").agg(
        F.max("ts").alias("last_contact_at"), F.count("*").alias("interactions"))


def apply_last_contacts(contacts: DataFrame, last: DataFrame) -> DataFrame:
    """Contacts with the later of their own and the given last contact; ``last``
    is :func:`last_contacts` of a table or the state a stream keeps."""
    newer = last.select(F.col("contact_id").alias("id"), F.col("last_contact_at").alias("_last"))
    kind = contacts.schema["last_contact_at"].dataType
    joined = contacts.join(newer, "id", "left")
    return joined.withColumns({
        "last_contact_at": F.greatest(F.col("last_contact_at"), F.col("_last").cast(kind)),
        "updated_at": F.greatest(F.col("updated_at"), F.col("_last").cast(kind)),
    }).select(*contacts.columns)
