"""Updates, deletions, completions and interaction logs."""

import datetime as dt

import pytest
from backends import Marker
from pyspark.sql import functions as F

from knowspark.operators import changes
from knowspark.sources.store import latest_rows, merge_changes

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 2, 1)
TASK = dict(status="open", priority="low", category="work", tags=["a"], created_at=T0,
            updated_at=T0)


def by_id(df):
    found = {r["id"]: r for r in df.collect()}
    assert len(found) == df.count()
    return found


@pytest.fixture(scope="module")
def tasks(make_store):
    return make_store(tasks=[
        dict(id="a", title="A", notes="n", due_date=dt.date(2024, 1, 10), recurrence_days=7,
             embedding=[1.0], **TASK),
        dict(id="b", title="B", due_date=dt.date(2024, 1, 10), recurrence_days=0, **TASK),
        dict(id="c", title="C", recurrence_days=7, **TASK),
        dict(id="d", title="D", due_date=dt.date(2024, 1, 31), **TASK)]).tasks


def test_updates_apply_one_after_another(spark, tasks):
    given = spark.createDataFrame(
        [("a", 1, "first", None), ("a", 3, None, "done"), ("a", 2, "second", "cancelled"),
         ("b", 1, None, None), ("zz", 1, "unknown", None)],
        "id string, version int, title string, status string")
    got = by_id(changes.apply_updates(tasks, given, "tasks", NOW))
    assert set(got) == set("abcd")
    assert (got["a"]["title"], got["a"]["status"], got["a"]["notes"]) == ("second", "done", "n")
    assert got["a"]["updated_at"] == NOW
    assert got["b"]["updated_at"] == T0 and got["b"]["title"] == "B"
    assert got["c"]["updated_at"] == T0
    once = changes.apply_updates(tasks, given, "tasks", NOW)
    assert by_id(changes.apply_updates(once, given, "tasks", NOW)) == by_id(once)
    assert once.schema.names == tasks.schema.names


def test_one_id_with_most_changes(spark, tasks):
    given = spark.range(20_000).select(
        F.lit("a").alias("id"), F.col("id").alias("version"),
        F.concat(F.lit("t"), F.col("id")).alias("title"))
    got = by_id(changes.apply_updates(tasks, given, "tasks", NOW))
    assert got["a"]["title"] == "t19999"


def test_unknown_columns_are_an_error(spark, tasks):
    given = spark.createDataFrame([("a", 1, "x")], "id string, version int, embedding string")
    with pytest.raises(ValueError, match="embedding"):
        changes.apply_updates(tasks, given, "tasks", NOW)


def test_updated_rows_are_the_touched_ones(spark, tasks):
    given = spark.createDataFrame(
        [("a", 1, "x"), ("b", 1, None)], "id string, version int, title string")
    newer = changes.updated_rows(tasks, given, "tasks", NOW)
    assert set(by_id(newer)) == {"a"}
    versions = tasks.withColumn("version", F.lit(1)).unionByName(
        newer.withColumn("version", F.lit(2)))
    assert by_id(latest_rows(versions).drop("version")) == by_id(
        changes.apply_updates(tasks, given, "tasks", NOW).select("id", *[
            c for c in tasks.columns if c != "id"]))


def test_merging_kept_changes(spark, tasks):
    first = spark.createDataFrame([("a", 1, "x"), ("d", 1, "y")], "id string, version int, title string")
    second = spark.createDataFrame([("a", 1, "z")], "id string, version int, title string")
    one = changes.updated_rows(tasks, first, "tasks", NOW).withColumn("version", F.lit(1))
    two = changes.updated_rows(tasks, second, "tasks", NOW).withColumn("version", F.lit(2))
    merged = merge_changes(tasks, latest_rows(one.unionByName(two)).drop("version"))
    assert {k: r["title"] for k, r in by_id(merged).items()} == {
        "a": "z", "b": "B", "c": "C", "d": "y"}


def test_reembedding(spark, tasks):
    given = spark.createDataFrame(
        [("a", 1, "New", None), ("b", 1, None, ""), ("d", 1, None, None), ("d", 2, None, None)],
        "id string, version int, title string, notes string")
    need = {r["id"]: r["text"] for r in changes.needs_reembed(tasks, given, "tasks").collect()}
    assert need == {"a": "New\nn", "b": "B"}
    got = by_id(changes.apply_updates(tasks, given, "tasks", NOW, make_embedder=Marker))
    assert got["a"]["embedding"] == [5.0] and got["b"]["embedding"] == [1.0]
    assert got["c"]["embedding"] is None
    other = spark.createDataFrame([("a", 1, "high")], "id string, version int, priority string")
    assert changes.needs_reembed(tasks, other, "tasks").count() == 0
    kept = by_id(changes.apply_updates(tasks, other, "tasks", NOW, make_embedder=Marker))
    assert kept["a"]["embedding"] == [1.0] and kept["a"]["priority"] == "high"


@pytest.fixture(scope="module")
def thoughts(make_store):
    rows = [dict(id="p", content="head", embedding=[0.0], chunk_index=0, updated_at=T0)] + [
        dict(id=f"k{i}", content=f"tail {i}", parent_id="p", chunk_index=i, updated_at=T0)
        for i in (1, 2)] + [dict(id="q", content="other", chunk_index=0, updated_at=T0)]
    return make_store(thoughts=rows).thoughts


def test_update_thoughts(spark, thoughts):
    given = spark.createDataFrame(
        [("p", 1, "longer head"), ("k2", 1, "new tail")], "id string, version int, content string")
    got = by_id(changes.update_thoughts(thoughts, given, NOW, make_embedder=Marker))
    assert got["p"]["content"] == "longer head" and got["p"]["embedding"] == [11.0]
    assert got["k1"]["content"] == "tail 1" and got["k2"]["content"] == "new tail"
    only = given.filter("id = 'p'")
    assert set(by_id(changes.update_thoughts(thoughts, only, NOW, rechunk=True))) == {"p", "q"}


def test_delete_thoughts(spark, thoughts):
    def left(*gone):
        ids = spark.createDataFrame([(g,) for g in gone], "id string")
        return set(by_id(changes.delete_thoughts(thoughts, ids)))
    assert left("p") == {"q"}
    assert left("k1") == {"p", "k1", "k2", "q"}
    assert left("q", "q", "none") == {"p", "k1", "k2"}


def test_delete_rows(spark, tasks):
    ids = spark.createDataFrame([("a",), ("zz",)], "id string")
    assert set(by_id(changes.delete_rows(tasks, ids))) == set("bcd")


def test_completions(spark, tasks):
    events = spark.createDataFrame(
        [("e1", "a"), ("e1", "a"), ("e2", "a"), ("e3", "b"), ("e4", "c"), ("e5", "zz")],
        "event_id string, id string")
    got = changes.complete_tasks(tasks, events, NOW).collect()
    state = {r["id"]: r for r in got if r["id"] in set("abcd")}
    assert {k: r["status"] for k, r in state.items()} == {
        "a": "done", "b": "done", "c": "done", "d": "open"}
    assert state["a"]["updated_at"] == NOW and state["d"]["updated_at"] == T0
    spawned = [r for r in got if r["id"] not in set("abcd")]
    assert len(spawned) == 2 and len({r["id"] for r in spawned}) == 2
    for r in spawned:
        assert r["due_date"] == dt.date(2024, 1, 17) and r["status"] == "open"
        assert (r["title"], r["notes"], r["tags"], r["embedding"]) == ("A", "n", ["a"], [1.0])
        assert r["created_at"] == NOW
    again = changes.next_tasks(tasks, events.repartition(3), NOW)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in spawned}


def test_complete_home(spark, make_store):
    home = make_store(home_items=[
        dict(id="a", name="A", interval_days=30, next_due_at=T0, updated_at=T0),
        dict(id="b", name="B", next_due_at=T0, updated_at=T0),
        dict(id="c", name="C", interval_days=1, last_done_at=T0, updated_at=T0)]).home_items
    events = spark.createDataFrame(
        [("a", NOW), ("a", T0), ("b", NOW)], "id string, ts timestamp")
    got = by_id(changes.complete_home(home, events))
    assert got["a"]["last_done_at"] == NOW
    assert got["a"]["next_due_at"] == NOW + dt.timedelta(days=30)
    assert got["b"]["next_due_at"] == T0 and got["b"]["last_done_at"] == NOW
    assert got["c"]["last_done_at"] == T0 and got["c"]["updated_at"] == T0


def test_log_interactions(spark, make_store):
    contacts = make_store(contacts=[
        dict(id=k, name=k.upper(), notes=n, last_contact_at=T0, updated_at=T0, embedding=[0.5])
        for k, n in {"null": None, "empty": "", "some": "old", "idle": "x"}.items()]).contacts
    t1, t2 = dt.datetime(2024, 1, 5, 9, 59, 59), dt.datetime(2024, 1, 5, 10)
    events = spark.createDataFrame(
        [(2, "some", t2, "second"), (1, "some", t1, "first"), (1, "some", t1, "first"),
         (3, "null", t1, "x"), (4, "empty", t1, "y"), (5, "unknown", t1, "z")],
        "event_id long, contact_id string, ts timestamp, note string")
    got = by_id(changes.log_interactions(contacts, events, Marker))
    assert got["some"]["notes"] == (
        "old\n\n2024-01-05 09:59 UTC: first\n\n2024-01-05 10:00 UTC: second")
    assert got["null"]["notes"] == "2024-01-05 09:59 UTC: x"
    assert got["empty"]["notes"] == "2024-01-05 09:59 UTC: y"
    assert got["some"]["last_contact_at"] == t2
    assert got["idle"]["notes"] == "x" and got["idle"]["embedding"] == [0.5]
    assert got["null"]["embedding"] == [float(len("NULL\n2024-01-05 09:59 UTC: x"))]
    last = changes.last_contacts(events)
    newer = by_id(changes.apply_last_contacts(contacts, last))
    assert newer["some"]["last_contact_at"] == t2 and newer["idle"]["last_contact_at"] == T0


def test_one_contact_with_most_interactions(spark, make_store):
    contacts = make_store(contacts=[dict(id="hot", name="H"), dict(id="cold", name="C")]).contacts
    events = spark.range(5000).select(
        F.col("id").alias("event_id"), F.lit("hot").alias("contact_id"),
        F.timestamp_seconds(F.col("id") * 977).alias("ts"), F.col("id").cast("string").alias("note"))
    notes = by_id(changes.log_interactions(contacts, events))["hot"]["notes"].split("\n\n")
    assert [n.rsplit(": ", 1)[1] for n in notes] == [str(i) for i in range(5000)]


def test_lines_of_a_hot_contact_are_joined_in_bounded_parts(spark, make_store, monkeypatch):
    """A third of all events of one contact within a second: counted parts."""
    monkeypatch.setattr(changes, "PART_LINES", 16)
    instant = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 == 0 else f"c{i % 40}", instant if i % 3 == 0 else
             instant + dt.timedelta(minutes=i), f"n{i}") for i in range(900)]
    events = spark.createDataFrame(rows + rows[:50], "event_id long, contact_id string, ts timestamp, "
                                                     "note string").repartition(5)
    placed = changes.numbered_lines(events)
    parts = placed.groupBy("id", F.floor(F.col("_place") / 16)).count().collect()
    assert max(r["count"] for r in parts) <= 16 and sum(r["count"] for r in parts) == 900
    store = make_store(contacts=[dict(id="hot", name="h", notes="first"), dict(id="none", name="n")])
    got = {r["id"]: r for r in changes.log_interactions(store.contacts, events).collect()}
    lines = got["hot"]["notes"].split("\n\n")
    assert lines[0] == "first" and [x.rsplit(" ", 1)[1] for x in lines[1:]] == [
        f"n{i}" for i in range(0, 900, 3)]
    assert got["none"]["notes"] is None
