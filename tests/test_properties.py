"""What must hold between operators on the given tables."""

import pytest
from pyspark.sql import functions as F

from knowspark.operators import agenda, changes, ingest, items, review, search, tags
from knowspark.sources import tables

AS_OF = "2001-07-20"


def test_counts_add_up(store):
    total = tags.tag_counts(store).agg(F.sum("count")).first()[0]
    assert total == items.unified_items(store).agg(F.sum(F.size("tags"))).first()[0]
    pairs = tags.tag_pairs(store)
    mirrored = pairs.select(F.col("related").alias("tag"), F.col("tag").alias("related"),
                            "co_occurrence")
    assert pairs.exceptAll(mirrored).count() == 0  # no tag repeats inside these items


@pytest.fixture(scope="module")
def all_related(store):
    return tags.related_all(store, 5).collect()


@pytest.fixture(scope="module")
def all_suggested(store):
    return search.suggest_all(store, 5).collect()


@pytest.mark.parametrize("tag", ["topic-3", "topic-11", "clerk-0", "en"])
def test_one_tag_is_a_slice_of_all(store, all_related, all_suggested, tag):
    one = [(r["tag"], r["co_occurrence"]) for r in tags.related_tags(store, tag, 5).collect()]
    assert one == [(r["related"], r["co_occurrence"]) for r in sorted(
        (r for r in all_related if r["tag"] == tag), key=lambda r: r["rank"])]
    one = [r["id"] for r in search.suggested_connections(store, tag, 5).collect()]
    assert one == [r["id"] for r in sorted(
        (r for r in all_suggested if r["tag"] == tag), key=lambda r: r["rank"])]


def test_chunks_are_dense(store):
    chunked = ingest.chunk(store.thoughts.select("id", "content", "content_type"))
    per_note = chunked.groupBy("id").agg(
        F.count("*").alias("n"), F.min("chunk_index").alias("first"),
        F.max("chunk_index").alias("last"), F.max("total_chunks").alias("total"))
    assert per_note.filter("first <> 0 OR last <> n - 1 OR total <> n").count() == 0
    assert per_note.count() == store.thoughts.count()


def test_dashboard_sections_match_their_lists(store):
    rows = {r["section"]: r["n"] for r in agenda.dashboard_rows(store, AS_OF)
            .groupBy("section").agg(F.count("*").alias("n")).collect()}
    assert rows == {name: df.count() for name, df in agenda.dashboard(store, AS_OF).items()}


def test_lists_are_sorted_across_partitions(store):
    due = [r["due_date"] for r in agenda.overdue_tasks(store, AS_OF).collect()]
    assert due == sorted(due) and len(due) > 100
    newest = [r["created_at"] for r in review.review_entries(store, "2024-01-12").collect()]
    assert newest == sorted(newest, reverse=True)
    counts = [(-r["count"], r["tag"]) for r in tags.tag_counts(store).collect()]
    assert counts == sorted(counts)


def test_order_of_changes_does_not_matter(spark, sf_dir):
    from knowspark.plans.queries import task_changes
    base, given = tables.tasks(spark, sf_dir), task_changes(spark, sf_dir)
    once = changes.apply_updates(base, given, "tasks", AS_OF)
    shuffled = changes.apply_updates(base, given.repartition(7, "version"), "tasks", AS_OF)
    assert once.exceptAll(shuffled).count() == 0 and once.count() == base.count()
    again = changes.apply_updates(once, given, "tasks", AS_OF)
    assert once.exceptAll(again).count() == 0
