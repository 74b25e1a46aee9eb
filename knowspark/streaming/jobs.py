"""Structured Streaming forms of ingest, last contact and activity.

Each function returns a started query. Checkpoints and outputs belong on shared
storage, so a restarted query carries on where the lost one stopped.
"""

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knowspark.operators.changes import log_interactions
from knowspark.operators.ingest import check, ingest, split_valid
from knowspark.operators.items import parents
from knowspark.streaming.versions import VersionedTable


def _started(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def thoughts_of_stream(entries: DataFrame, delay: str = "1 hour",
                       make_embedder: Callable = None) -> DataFrame:
    """Validated, deduplicated, chunked and optionally embedded entries.

    Entries carry no time of their own, so repeats are recognised within
    ``delay`` of arrival. Duplicates go before chunking: the state holds one key
    per entry, and only for that long.
    """
    arrived = entries.withColumn("arrived_at", F.current_timestamp()) \
        .withWatermark("arrived_at", delay)
    valid, _ = split_valid(check(arrived, "entries"))
    once = valid.dropDuplicatesWithinWatermark(["entry_id"])
    if "created_at" not in once.columns:
        once = once.withColumn("created_at", F.col("arrived_at"))
    return ingest(once.drop("arrived_at"), make_embedder=make_embedder)


def stream_ingest(entries: DataFrame, path: str, checkpoint: str, delay: str = "1 hour",
                  make_embedder: Callable = None, available_now: bool = False) -> StreamingQuery:
    """Appends the thoughts of a stream of entries to Parquet files."""
    rows = thoughts_of_stream(entries, delay, make_embedder)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return _started(writer, checkpoint, available_now)


def stream_last_contact(interactions: DataFrame, path: str, checkpoint: str,
                        available_now: bool = False, delay: str = "1 day") -> StreamingQuery:
    """Latest interaction and count per contact, kept up to date. An event
    delivered again within ``delay`` of its arrival counts once; no event is too late.

    Every batch commits the contacts it changed to a :class:`VersionedTable`, so
    the result of :func:`read_last_contact` does not depend on retries, and what a
    reader opens does not grow with the number of batches.
    """
    running = _once(interactions, delay).groupBy("contact_id").agg(
        F.max("ts").alias("last_contact_at"), F.count("*").alias("interactions"))
    writer = running.writeStream.outputMode("update").foreachBatch(_last_contacts(path).apply)
    return _started(writer, checkpoint, available_now)


def _once(interactions: DataFrame, delay: str) -> DataFrame:
    """Each event once, if it comes again within ``delay`` of its arrival."""
    return interactions.withColumn("_seen", F.current_timestamp()) \
        .withWatermark("_seen", delay).dropDuplicatesWithinWatermark(["event_id"])


def _last_contacts(path: str) -> VersionedTable:
    return VersionedTable(path, ("contact_id",))


def read_last_contact(spark, path: str) -> DataFrame:
    """The current state: the newest row of each contact."""
    return _last_contacts(path).read(spark)


def apply_interactions(contacts: VersionedTable, batch: DataFrame, batch_id: int,
                       make_embedder: Callable = None) -> bool:
    """One batch of interactions applied to a table of contacts, once: the contacts
    it names get its lines, their last contact and, with a model, a new vector."""
    spark = batch.sparkSession
    if batch_id <= contacts.applied(spark):
        return False
    events = contacts.staged(batch.select("event_id", "contact_id", "ts", "note"), batch_id)
    named = events.select(F.col("contact_id").alias("id")).distinct()
    touched = contacts.read(spark).join(named, "id", "left_semi")
    return contacts.apply(log_interactions(touched, events, make_embedder), batch_id)


def stream_interactions(interactions: DataFrame, contacts: VersionedTable, checkpoint: str,
                        make_embedder: Callable = None, available_now: bool = False,
                        delay: str = "1 day") -> StreamingQuery:
    """Keeps the notes, last contact and vectors of a table of contacts up to date
    with a stream of interactions. Lines of one batch are in order of time, batches in
    order of arrival; an event delivered again within ``delay`` counts once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        apply_interactions(contacts, batch, batch_id, make_embedder)

    writer = _once(interactions, delay).writeStream.outputMode("append").foreachBatch(write)
    return _started(writer, checkpoint, available_now)


def activity(thoughts: DataFrame, time: str, length: str, slide: str = None) -> DataFrame:
    """Counts per window by content type and by tag, from a stream or a table.

    Chunk rows are parts of a note and do not count. Both facets come from one
    pass; counts are combined before the shuffle, so a tag on a third of all rows
    is no hot spot.
    """
    if "parent_id" in thoughts.columns:
        thoughts = parents(thoughts)
    facets = F.concat(
        F.array(F.struct(F.lit("type").alias("facet"), F.col("content_type").alias("value"))),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")),
                    lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))))
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return (
        thoughts.select(time, F.explode_outer(facets).alias("f"))
        .groupBy(window.alias("window"), "f.facet", "f.value").agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"),
                "facet", "value", "n")
    )


def stream_rejected(entries: DataFrame, path: str, checkpoint: str,
                    available_now: bool = False) -> StreamingQuery:
    """Appends the entries that validation refuses, with the reasons, to files of
    their own: the other half of :func:`stream_ingest`."""
    _, refused = split_valid(check(entries, "entries"))
    writer = refused.writeStream.format("parquet").outputMode("append").option("path", path)
    return _started(writer, checkpoint, available_now)


def stream_activity_now(thoughts: DataFrame, path: str, checkpoint: str, time: str = "created_at",
                        length: str = "7 days", slide: str = "1 day", delay: str = "1 day",
                        available_now: bool = False) -> StreamingQuery:
    """Counts of all windows, open ones too, kept up to date. Every batch commits
    the windows it changed; :func:`read_activity` gives the newest counts."""
    counted = activity(thoughts.withWatermark(time, delay), time, length, slide)
    writer = counted.writeStream.outputMode("update").foreachBatch(_activity(path).apply)
    return _started(writer, checkpoint, available_now)


def _activity(path: str) -> VersionedTable:
    return VersionedTable(path, ("start", "end", "facet", "value"))


def read_activity(spark, path: str) -> DataFrame:
    """The newest counts of each window and value."""
    return _activity(path).read(spark)


def stream_activity(thoughts: DataFrame, path: str, checkpoint: str, time: str = "created_at",
                    length: str = "7 days", slide: str = "1 day", delay: str = "1 day",
                    available_now: bool = False) -> StreamingQuery:
    """Appends each window once it is closed; rows later than ``delay`` are dropped."""
    counted = activity(thoughts.withWatermark(time, delay), time, length, slide)
    writer = counted.writeStream.format("parquet").outputMode("append").option("path", path)
    return _started(writer, checkpoint, available_now)
