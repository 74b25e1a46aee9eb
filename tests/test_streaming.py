"""Streams over several files give what the batch operators give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knowspark import schema
from knowspark.operators import changes, ingest
from knowspark.session import new_work_path
from knowspark.sources import tables
from knowspark.streaming import jobs
from knowspark.streaming.versions import VersionedTable

ENTRY_FIELDS = "entry_id, content, content_type, title, tags, source, metadata"


def rows(df, *drop):
    return sorted(map(repr, df.drop(*drop).collect()))


def write_files(df, path, n):
    for i in range(n):
        df.filter(F.pmod(F.xxhash64(df.columns[0]), F.lit(n)) == i).coalesce(1) \
            .write.mode("append").parquet(path)


@pytest.fixture(scope="module")
def entries(spark, sf_dir):
    from knowspark.sources import tables
    return tables.entries(spark, sf_dir).drop("created_at")


def test_ingest_with_repeats_and_restart(spark, entries):
    root = new_work_path(spark, "stream")
    write_files(entries, f"{root}/in", 3)

    def run():
        source = spark.readStream.schema(schema.ENTRIES).option("maxFilesPerTrigger", 1) \
            .parquet(f"{root}/in")
        jobs.stream_ingest(source, f"{root}/out", f"{root}/check", available_now=True,
                           make_embedder=ingest.HashEmbedder).awaitTermination()
        return spark.read.parquet(f"{root}/out")

    valid, _ = ingest.validate(entries, "entries")
    want = rows(ingest.ingest(valid, "2024-01-01", ingest.HashEmbedder), "created_at", "updated_at")
    assert rows(run(), "created_at", "updated_at") == want
    # the same entries delivered again, and a new one
    extra = entries.limit(1).withColumn("entry_id", F.lit("new")) \
        .withColumn("content_type", F.lit("thought"))
    entries.unionByName(extra).coalesce(1).write.mode("append").parquet(f"{root}/in")
    again = run()
    assert again.filter("entry_id = 'new'").count() == 1
    assert rows(again.filter("entry_id <> 'new'"), "created_at", "updated_at") == want


def test_last_contact(spark, sf_dir):
    from knowspark.sources import tables
    events = tables.interactions(spark, sf_dir)
    root = new_work_path(spark, "stream")
    write_files(events, f"{root}/in", 4)
    events.filter("event_id % 5 = 0").coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{root}/in")
    jobs.stream_last_contact(source, f"{root}/out", f"{root}/check", True).awaitTermination()
    state = jobs.read_last_contact(spark, f"{root}/out")
    assert rows(state.select("contact_id", "last_contact_at", "interactions")) == rows(
        changes.last_contacts(events))
    contacts = tables.contacts(spark, sf_dir)
    newer = changes.apply_last_contacts(contacts, state)
    logged = changes.log_interactions(contacts, events)
    later = "greatest(last_contact_at, updated_at)"
    assert newer.count() == logged.count() and newer.filter(f"last_contact_at > {later}").count() == 0


def test_activity_closes_windows_and_drops_late_rows(spark, make_store):
    def thought(i, day, hour=0, kind="note", tags=("x",)):
        return dict(id=f"t{i}", content="c", content_type=kind, tags=list(tags),
                    created_at=dt.datetime(2024, 1, day, hour))
    root = new_work_path(spark, "stream")
    first = [thought(0, 1), thought(1, 1, 5, "event", ["x", "y"]), thought(2, 10)]
    second = [thought(3, 2), thought(4, 9, 12), thought(5, 30)]  # t3 is late
    for part in (first, second):
        make_store(thoughts=part).thoughts.coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(schema.THOUGHTS).parquet(f"{root}/in")
        jobs.stream_activity(source, f"{root}/out", f"{root}/check", length="1 day", slide=None,
                             available_now=True).awaitTermination()
    got = rows(spark.read.parquet(f"{root}/out"))
    kept = make_store(thoughts=[t for t in first + second if t["id"] != "t3"]).thoughts
    batch = jobs.activity(kept, "created_at", "1 day").filter("end <= timestamp'2024-01-29'")
    assert got == rows(batch) and len(got) > 4


def test_activity_counts(make_store):
    store = make_store(thoughts=[
        dict(id="a", content="c", content_type="note", tags=["x", "x"], created_at=dt.datetime(2024, 1, 3)),
        dict(id="b", content="c", content_type="note", tags=None, created_at=dt.datetime(2024, 1, 4))])
    sliding = jobs.activity(store.thoughts, "created_at", "7 days", "1 day")
    assert sliding.filter("facet = 'type'").agg(F.sum("n")).first()[0] == 14
    daily = jobs.activity(store.thoughts, "created_at", "1 day")
    assert {(r["facet"], r["value"], r["n"]) for r in daily.collect()} == {
        ("type", "note", 1), ("tag", "x", 2)}


# Versioned tables ---------------------------------------------------------------


def changed(spark, batch, keys):
    return spark.createDataFrame([(k, batch) for k in keys], "key string, value long")


def values(table, spark):
    return {r["key"]: r["value"] for r in table.read(spark).collect()}


def test_versions_read_a_bounded_number_of_files(spark):
    """Twenty batches: always the newest value of each key, never more folders."""
    table = VersionedTable(new_work_path(spark, "versions"), ("key",), fold=3, generations=2)
    with pytest.raises(ValueError, match="nothing is committed"):
        table.read(spark)
    want, opened = {}, []
    for batch in range(20):
        keys = [f"k{batch % 4}", f"k{batch % 7}", None] if batch % 5 else []
        want.update({k: batch for k in keys})
        assert table.apply(changed(spark, batch, set(keys)), batch)
        assert values(table, spark) == want
        opened.append(len({f.rsplit("/", 1)[0] for f in table.read(spark).inputFiles()}))
    assert max(opened) <= 3 and table.applied(spark) == 19


def test_a_batch_counts_once(spark):
    table = VersionedTable(new_work_path(spark, "versions"), ("key",), fold=2)
    table.create(changed(spark, -1, ["a", "b"]))
    table.create(changed(spark, -9, ["z"]))  # there already
    assert table.apply(changed(spark, 0, ["a"]), 0)
    assert not table.apply(changed(spark, 7, ["a", "c"]), 0)
    assert values(table, spark) == {"a": 0, "b": -1}


@pytest.mark.parametrize("fails_at", ["delta", "fold", "commit"])
def test_a_batch_that_failed_runs_again(spark, monkeypatch, fails_at):
    """Whatever step the first run dies before, readers see all of a batch or nothing."""
    table = VersionedTable(new_work_path(spark, "versions"), ("key",), fold=2)
    table.apply(changed(spark, 0, ["a", "b"]), 0)

    def die(*_):
        raise OSError("lost")

    step = {"delta": "_folder", "fold": "_rows", "commit": "_commit"}[fails_at]
    monkeypatch.setattr(table, step, die)
    with pytest.raises(OSError):
        table.apply(changed(spark, 1, ["b", "c"]), 1)
    monkeypatch.undo()
    assert values(table, spark) == {"a": 0, "b": 0}
    assert table.apply(changed(spark, 1, ["b", "c"]), 1)
    assert values(table, spark) == {"a": 0, "b": 1, "c": 1}


def test_a_reader_overlaps_later_batches(spark):
    table = VersionedTable(new_work_path(spark, "versions"), ("key",), fold=2, generations=3)
    for batch in range(3):
        table.apply(changed(spark, batch, ["a", f"b{batch}"]), batch)
    early = table.read(spark)
    for batch in range(3, 6):
        table.apply(changed(spark, batch, ["a"]), batch)
    assert {r["key"]: r["value"] for r in early.collect()} == {"a": 2, "b0": 0, "b1": 1, "b2": 2}


def test_interactions_stream_into_contacts(spark, sf_dir):
    """Restarted after more files arrived, with batches delivered again."""
    from knowspark.sources import tables
    root = new_work_path(spark, "stream")
    events, contacts = tables.interactions(spark, sf_dir), tables.contacts(spark, sf_dir)
    table = VersionedTable(f"{root}/contacts", ("id",), fold=2)
    table.create(contacts)
    cut = "ts < timestamp_ntz'2024-01-15'"
    for part in (cut, f"NOT ({cut})"):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        jobs.stream_interactions(source, table, f"{root}/check", available_now=True) \
            .awaitTermination()
    assert not jobs.apply_interactions(table, events, table.applied(spark))
    assert rows(table.read(spark)) == rows(changes.log_interactions(contacts, events))


# Registered streams -------------------------------------------------------------


@pytest.mark.parametrize("name, count", [
    ("stream_ingest", 534), ("stream_rejected", 66), ("stream_activity", None),
    ("stream_activity_all", None), ("stream_last_contact", 4), ("stream_contacts", 4)])
def test_streams_read_tables_of_several_files(spark, tmp_path_factory, name, count):
    """A table may be a folder of files."""
    from knowspark.plans.queries import QUERIES
    day, root = dt.datetime(2024, 1, 1), tmp_path_factory.mktemp("tables")
    made = {
        "documents": [(i, f"text {i}", "en", "web", 6) for i in range(600)],
        "conversations": [(i // 3, i % 3, "user", f"turn {i}") for i in range(30)],
        "events": [(i, day + dt.timedelta(hours=i), i % 4, "click", 1.5, "{}") for i in range(40)],
        "orders": [(1, 2, "O", 1.0, day, "1-URGENT")],
        "customer": [(i, f"name {i}", 1, 0.0, "BUILDING") for i in range(4)],
        "embeddings": [(2, [1.0, 0.0], 0)],
    }
    for table, values in made.items():
        spark.createDataFrame(values, tables.SCHEMAS[table]).repartition(3).write.parquet(
            f"{root}/{table}.parquet")
    if count is None:  # windows of the whole tables; those of stream_activity are closed
        thoughts = tables.thoughts(spark, str(root)).select(
            "created_at", "content_type", "tags", "parent_id")
        closed = "end <= timestamp'2024-01-15 09:23:00'"  # a day before document 599
        if name == "stream_activity_all":
            thoughts, closed = thoughts.unionByName(
                tables.chunk_rows(spark, str(root)).select(*thoughts.columns)), "true"
        count = jobs.activity(thoughts.withColumn("created_at", F.col("created_at").cast("timestamp")),
                              "created_at", "7 days", "1 day").filter(closed).count()
    assert QUERIES[name](spark, str(root)).count() == count > 0
