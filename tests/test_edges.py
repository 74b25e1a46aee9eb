"""Semantics that are easy to get wrong, on inline rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knowspark.functions import labels, times, vectors
from knowspark.operators import agenda, items, notes, review, tags
from knowspark.plans import reports

NOW = dt.datetime(2024, 3, 10, 12)


def at(days=0, **more):
    return NOW - dt.timedelta(days=days, **more)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_only_parents_are_items_but_stats_count_chunks(make_store):
    store = make_store(thoughts=[
        dict(id="p", content="a", content_type="note", tags=["x"], created_at=at()),
        dict(id="c", content="b", content_type="note", tags=["x"], created_at=at(), parent_id="p",
             chunk_index=1)])
    assert ids(items.unified_items(store)) == ["p"]
    assert [tuple(r) for r in tags.tag_counts(store).collect()] == [("x", 1)]
    assert ids(review.recent(store)) == ["p"]
    assert review.stats_total(store).first()["total"] == 2
    assert review.stats_by_type(store).first()["n"] == 2


def test_item_content_of_empty_notes(make_store):
    store = make_store(tasks=[dict(id="a", title="T", notes=""), dict(id="b", title="T")])
    got = {r["id"]: r["content"] for r in items.unified_items(store).collect()}
    assert got == {"a": "T\n", "b": "T"}


def test_repeated_and_null_tags(make_store):
    store = make_store(
        tasks=[dict(id="a", title="T", tags=["x", "x", "y"]), dict(id="b", title="T", tags=None),
               dict(id="c", title="T", tags=[]), dict(id="d", title="T", tags=["x", None])])
    assert {(r["tag"], r["count"]) for r in tags.tag_counts(store).collect()} == {
        ("x", 3), ("y", 1), (None, 1)}
    assert [tuple(r) for r in tags.related_tags(store, "y").collect()] == [("x", 2)]
    assert [tuple(r) for r in tags.related_tags(store, "x").collect()] == [("y", 1)]
    assert {tuple(r) for r in tags.tag_pairs(store).collect()} == {("x", "y", 1), ("y", "x", 2)}
    assert sorted(ids(items.items_by_tag(store, "x"))) == ["a", "d"]


def test_due_windows(make_store):
    day = dt.date(2024, 3, 10)
    due = {"late": -1, "today": 0, "week": 7, "later": 8}
    store = make_store(
        tasks=[dict(id=k, title=k, status="open", priority="low", category="work",
                    due_date=day + dt.timedelta(days=n)) for k, n in due.items()]
        + [dict(id="none", title="n", status="open", priority="high", category="work"),
           dict(id="done", title="n", status="done", priority="low", category="home",
                due_date=day - dt.timedelta(days=3)),
           dict(id="undated", title="n", status="cancelled", priority="low", category="x")])
    assert ids(agenda.overdue_tasks(store, NOW)) == ["late"]
    assert ids(agenda.due_soon_tasks(store, NOW)) == ["today", "week"]
    assert ids(agenda.list_tasks(store, NOW, "open", None, 7)) == ["late", "today", "week"]
    assert ids(agenda.list_tasks(store, NOW)) == [
        "none", "done", "late", "today", "week", "later", "undated"]
    ranks = {r["id"]: r["rank"] for r in agenda.list_tasks(store, NOW, rank=True).collect()}
    assert sorted(ranks, key=ranks.get) == ids(agenda.list_tasks(store, NOW))
    assert sorted(ranks.values()) == list(range(1, 8))
    assert ids(agenda.list_tasks(store, NOW, category="home")) == ["done"]
    assert ids(agenda.list_tasks(store, NOW, "open", None, 0)) == ["late", "today"]


def test_home_windows(make_store):
    store = make_store(home_items=[
        dict(id="late", name="a", next_due_at=at(0, seconds=1)), dict(id="now", name="b", next_due_at=NOW),
        dict(id="edge", name="c", next_due_at=at(-7)),
        dict(id="out", name="d", next_due_at=at(-7, seconds=-1)), dict(id="none", name="e")])
    assert ids(agenda.overdue_home(store, NOW)) == ["late"]
    assert ids(agenda.due_soon_home(store, NOW)) == ["now", "edge"]
    assert ids(agenda.list_home_items(store, NOW, 7)) == ["late", "now", "edge"]
    assert ids(agenda.list_home_items(store, NOW)) == ["late", "now", "edge", "out", "none"]


def test_exactly_fourteen_days_differs(make_store):
    store = make_store(contacts=[
        dict(id="never", name="a"), dict(id="edge", name="b", last_contact_at=at(14)),
        dict(id="old", name="c", last_contact_at=at(14, seconds=1)),
        dict(id="new", name="d", last_contact_at=at(1))])
    assert ids(agenda.contacts_to_reach(store, NOW)) == ["never", "old"]
    assert sorted(ids(agenda.stale_contacts_days(store, NOW))) == ["edge", "never", "old"]
    assert ids(agenda.list_contacts(store, NOW, 0)) == ["never", "old", "edge", "new"]


def test_date_range_is_inclusive(make_store):
    store = make_store(thoughts=[
        dict(id=k, content="x", content_type="note", created_at=at(n))
        for k, n in (("a", 0), ("b", 1), ("c", 2), ("d", 3))])
    got = review.by_date_range(store, at(2).isoformat() + "Z", at(1).isoformat())
    assert ids(got) == ["b", "c"]
    assert ids(review.by_date_range(store, at(3), at(0), limit=2)) == ["a", "b"]


def test_top_tags_keep_first_appearance(make_store):
    store = make_store(thoughts=[
        dict(id="new", content="x", content_type="note", tags=["zebra", "ant"], created_at=at(1)),
        dict(id="old", content="x", content_type="event", tags=["bee", "ant"], created_at=at(2)),
        dict(id="gone", content="x", content_type="event", tags=["old"], created_at=at(8))])
    got = [(r["tag"], r["count"]) for r in review.review_top_tags(store, NOW).collect()]
    assert got == [("ant", 2), ("zebra", 1), ("bee", 1)]
    report = reports.weekly_review(store, NOW)
    assert report["total"].first()[0] == 2
    assert {tuple(r) for r in report["by_type"].collect()} == {("note", 1), ("event", 1)}
    assert ids(report["entries"]) == ["new", "old"]


def test_any_tag(make_store):
    store = make_store(thoughts=[
        dict(id=k, content="x", content_type="note", tags=t, created_at=at(n))
        for n, (k, t) in enumerate({"a": ["x"], "b": ["y", None], "c": ["z"], "d": None}.items())])
    assert ids(review.by_any_tag(store, ["x", "y"])) == ["a", "b"]
    assert ids(review.by_any_tag(store, [])) == []


def test_reassemble_and_child_lookup(make_store, spark):
    store = make_store(thoughts=[
        dict(id="p", content="one", title="T", content_type="note", chunk_index=0, created_at=at())]
        + [dict(id=f"c{i}", content=f"part {i}", content_type="note", chunk_index=i, parent_id="p",
                created_at=at()) for i in range(600, 0, -1)])
    whole = notes.reassemble(store.thoughts).collect()
    assert len(whole) == 1 and whole[0]["total_chunks"] == 601 and whole[0]["title"] == "T"
    assert whole[0]["content"] == "\n\n".join(["one"] + [f"part {i}" for i in range(1, 601)])
    asked = spark.createDataFrame([("p",), ("c7",), ("c7",), ("none",)], "id string")
    got = {r["id"]: r for r in notes.thoughts_full(store.thoughts, asked).collect()}
    assert set(got) == {"p", "c7"}
    assert got["c7"]["content"] == "part 7" and got["c7"]["total_chunks"] == 1
    assert got["p"]["content"] == whole[0]["content"]


def test_parse_notes(make_store):
    text = ("profile one\n\n2024-01-01 10:00 UTC: first\nline\n\n\n  tail  \n\n"
            "2024-01-02 10:00:30 UTC: second \n\n2024-01-01 10:00 UTC: third\n\n2024-1-1: no")
    store = make_store(contacts=[dict(id="a", name="A", notes=text), dict(id="b", name="B"),
                                 dict(id="c", name="C", notes="")])
    got = {r["id"]: r for r in notes.parse_notes(store.contacts).collect()}
    assert got["a"]["profile"] == "profile one\n\ntail\n\n2024-1-1: no"
    assert [tuple(i) for i in got["a"]["interactions"]] == [
        ("2024-01-02 10:00:30 UTC", "second"), ("2024-01-01 10:00 UTC", "first\nline"),
        ("2024-01-01 10:00 UTC", "third")]
    for k in "bc":
        assert got[k]["profile"] == "" and got[k]["interactions"] == []
    assert notes.interactions_of(store.contacts).count() == 3


@pytest.mark.parametrize("age,short,long", [
    (30, "just now", "just now"), (-60, "just now", "just now"), (60, "1m", "1m"),
    (3599, "59m", "59m"), (3600, "1h", "1h"), (86_400, "1d", "1d"), (86_400 * 29, "29d", "29d"),
    (86_400 * 30, "30d", "1mo"), (86_400 * 65, "65d", "2mo")])
def test_rel_time(spark, age, short, long):
    df = spark.createDataFrame([(NOW - dt.timedelta(seconds=age),)], "t timestamp")
    assert tuple(df.select(labels.rel_time("t", NOW), labels.rel_time("t", NOW, True)).first()) == (
        short, long)


@pytest.mark.parametrize("hours,label,kind", [
    (None, "—", ""), (-25, "1d overdue", "overdue"), (-23, "due today", "due-soon"),
    (0, "due today", "due-soon"), (1, "due in 1d", "due-soon"), (168, "due in 7d", "due-soon"),
    (169, "due in 8d", "")])
def test_home_due_label(spark, hours, label, kind):
    when = None if hours is None else NOW + dt.timedelta(hours=hours)
    df = spark.createDataFrame([(when,)], "t timestamp")
    assert tuple(df.select(
        labels.home_due_label("t", NOW), labels.home_due_class("t", NOW)).first()) == (label, kind)


@pytest.mark.parametrize("days,label", [
    (None, ""), (-3, "3d overdue"), (0, "today"), (1, "tomorrow"), (2, "in 2d")])
def test_task_due_label(spark, days, label):
    when = None if days is None else NOW.date() + dt.timedelta(days=days)
    df = spark.createDataFrame([(when, "open")], "d date, status string")
    got = df.select(labels.task_due_label("d", NOW), labels.is_overdue("d", "status", NOW)).first()
    assert tuple(got) == (label, days is not None and days < 0)


@pytest.mark.parametrize("name,short", [
    ("Ada Lovelace", "AL"), ("ada", "A"), ("a  b", "A"), ("x y z", "XY"), ("éa ß", "ÉSS")])
def test_initials(spark, name, short):
    assert spark.createDataFrame([(name,)], "n string").select(labels.initials("n")).first()[0] == short


@pytest.mark.parametrize("sim,pct", [(0.125, 13), (0.005, 1), (-0.005, 0), (-0.125, -12), (1.0, 100)])
def test_percent_rounds_half_up(spark, sim, pct):
    df = spark.createDataFrame([(sim,)], "s double")
    assert df.select(labels.similarity_pct("s")).first()[0] == pct


def test_labels_of_contacts_and_text(spark):
    df = spark.createDataFrame([("", None, "Acme")], "a string, b string, c string")
    assert df.select(labels.contact_details("a", "b", "c")).first()[0] == "Acme"
    assert df.select(labels.display_text("a", "c")).first()[0] == "Acme"
    assert df.select(labels.display_text("a", "b")).first()[0] == ""
    df = spark.createDataFrame([(None,), (at(0),), (at(1),), (at(2, hours=1),)], "t timestamp")
    assert [r[0] for r in df.select(labels.last_contact_label("t", NOW)).collect()] == [
        "never contacted", "today", "1d ago", "2d ago"]


def test_iso_text_both_ways(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.250000+00:00",)],
                               "s string").select(times.parse_iso("s").alias("t"))
    assert [r[0] for r in df.select(times.to_iso("t")).collect()] == [
        "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.250000+00:00"]
    assert times.instant("2024-01-02T03:04:05+02:00") == dt.datetime(2024, 1, 2, 1, 4, 5)
    assert times.instant(dt.date(2024, 1, 2)) == dt.datetime(2024, 1, 2)


def test_cosine_of_zero_and_text_of_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<float>, b array<float>")
    first, second = [r[0] for r in df.select(vectors.cosine_similarity("a", "b")).collect()]
    assert abs(first - 1) < 1e-12 and second is None
    back = df.select("a", vectors.parse_vector(vectors.format_vector("a")).alias("back"))
    assert back.filter(F.col("a") != F.col("back")).count() == 0
    assert df.select(vectors.format_vector("a")).first()[0] == "[1.0,2.0]"


def test_contacts_by_name_and_tag_filter(make_store):
    store = make_store(contacts=[dict(id="a", name="Ada L", tags=["Math", "math-2"]),
                                 dict(id="b", name="Bob", tags=["x"])])
    assert ids(agenda.contacts_by_name(store, " ADA")) == ["a"]
    assert sorted(ids(agenda.contacts_by_name(store, " "))) == ["a", "b"]
    assert [r["tag"] for r in tags.tags_matching(store, "MATH").collect()] == ["math-2"]
    assert tags.tags_matching(store, "").count() == 3


def test_both_timestamp_kinds(make_store):
    """Operators take timestamps with and without zone."""
    store = make_store(home_items=[dict(id="a", name="a", next_due_at=at(1))])
    plain = store.home_items.withColumn("next_due_at", F.col("next_due_at").cast("timestamp_ntz"))
    other = type(store)(store.thoughts, store.tasks, store.contacts, plain)
    for s in (store, other):
        assert ids(agenda.overdue_home(s, NOW)) == ["a"]
        assert [r["section"] for r in agenda.dashboard_rows(s, NOW).collect()] == ["overdue_home"]


def test_tag_page(store):
    page = reports.tag_page(store, "topic-3")
    assert page["items"].count() > 0 and page["related_tags"].count() == 10
    assert page["suggested"].count() == 8
    assert reports.tag_page(store, "no such tag")["suggested"].count() == 0
    assert set(reports.dashboard(store, "2001-07-20")) == {
        "overdue_tasks", "due_soon_tasks", "overdue_home", "due_soon_home", "contacts_to_reach"}
    assert set(reports.stats(store)) == {"by_type", "total", "range"}
