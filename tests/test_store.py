"""Snapshots, appends, and what reaches the Parquet scan."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException

from knowspark import schema
from knowspark.operators import agenda, items, review, search, tags
from knowspark.session import configure, new_work_path, work_dir
from knowspark.sources.store import Store, read_store, write_store

AS_OF = "2001-07-20"


@pytest.fixture(scope="module")
def stored(spark, store):
    root = new_work_path(spark, "store")
    for name in Store.table_names():
        write_store(store.table(name), root, name)
    return read_store(spark, root)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshots_and_appends(spark, make_store):
    root, later = new_work_path(spark, "store"), new_work_path(spark, "store")
    others = ("thoughts", "contacts", "home_items")
    first = make_store(tasks=[dict(id="a", title="A", due_date=dt.date(2024, 1, 1))]).tasks
    more = make_store(tasks=[dict(id="b", title="B")]).tasks
    write_store(first, root, "tasks")
    write_store(more.select("id", "title"), root, "tasks", append=True)
    before = read_store(spark, root, others).tasks
    assert {r["id"] for r in before.collect()} == {"a", "b"}
    write_store(before.filter("id = 'b'"), later, "tasks")
    assert {r["id"] for r in read_store(spark, later, others).tasks.collect()} == {"b"}
    assert {r["id"] for r in before.collect()} == {"a", "b"}
    assert read_store(spark, root, others).contacts.count() == 0
    with pytest.raises(AnalysisException):  # written already
        write_store(first, root, "tasks")
    with pytest.raises(ValueError):
        write_store(first.withColumnRenamed("notes", "remarks"), later, "tasks")
    with pytest.raises(ValueError):
        read_store(spark, root, others).table("others")
    with pytest.raises(ValueError):
        read_store(spark, root, ("others",))


def test_a_wrong_path_is_an_error(spark):
    with pytest.raises(AnalysisException):
        read_store(spark, new_work_path(spark, "nowhere"))


def test_stored_types(stored):
    for name, struct in schema.TABLES.items():
        assert [(f.name, f.dataType) for f in stored.table(name).schema] == [
            (f.name, f.dataType) for f in struct]


def test_stored_results_equal(store, stored):
    for run in (lambda s: tags.tag_counts(s), lambda s: agenda.dashboard_rows(s, AS_OF),
                lambda s: review.stats_by_type(s)):
        assert sorted(map(tuple, run(store).collect())) == sorted(map(tuple, run(stored).collect()))


def test_filters_reach_the_scan(stored):
    text = plan(agenda.overdue_tasks(stored, AS_OF))
    assert "EqualTo(status,open)" in text and "LessThan(due_date,2001-07-20)" in text
    text = plan(review.by_date_range(stored, "2024-01-01", "2024-01-02"))
    assert "GreaterThanOrEqual(created_at" in text and "IsNull(parent_id)" in text
    assert "LessThan(next_due_at" in plan(agenda.overdue_home(stored, AS_OF))
    assert "In(id, [" in plan(items.get_rows(stored.tasks, ["t1", "t2"]))


def test_only_needed_columns_are_read(stored):
    text = plan(tags.tag_counts(stored))
    assert "embedding" not in text and "content" not in text
    assert "ReadSchema: struct<tags:array<string>>" in text
    text = plan(agenda.list_tasks(stored, AS_OF))
    assert "embedding" not in text


def test_content_type_filter_removes_branches(stored, spark):
    q = [0.1] * 64
    assert plan(search.search(stored, q)).count("FileScan") == 4
    text = plan(search.search(stored, q, content_type="task"))
    assert text.count("FileScan") == 2  # a thought may carry any type
    assert "EqualTo(content_type,task)" in text


def test_search_scores_each_row_once_and_limits_per_task(stored):
    text = plan(search.search(stored, [0.1] * 64))
    assert text.count("ArrowEvalPython") == 4
    assert "TakeOrderedAndProject" in text


def test_search_of_stored_rows(store, stored, spark, sf_dir):
    from knowspark.sources.tables import query_vector
    q = query_vector(spark, sf_dir)
    want = [r["id"] for r in search.search(store, q).collect()]
    assert [r["id"] for r in search.search(stored, q).collect()] == want


def test_tag_index(spark, stored):
    path = new_work_path(spark, "tags")
    items.write_tag_index(stored, path)
    want = [tuple(r) for r in items.items_by_tag(stored, "topic-3").collect()]
    found = items.items_by_tag_indexed(spark, path, "topic-3")
    assert [tuple(r) for r in found.collect()] == want
    assert "EqualTo(tag,topic-3)" in plan(found)


def test_get_and_lookup(spark, stored):
    ids = spark.createDataFrame([("t1",), ("t1",), ("none",)], "id string")
    assert [r["id"] for r in items.lookup(stored.tasks, ids).collect()] == ["t1"]
    assert [r["id"] for r in items.get_rows(stored.tasks, ["t1", "none"]).collect()] == ["t1"]


def test_work_folder_comes_from_the_session(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_work_path(spark, "x") != new_work_path(spark, "x")


def test_configure_sizes_shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        configure(spark, shuffle_bytes=10**12)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 7451
        configure(spark, shuffle_bytes=100 * 10**12)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 50_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
