"""Physical plans of all queries: what must not appear at scale."""

import re

import pytest

import __spark_entry__ as entry
from knowspark.plans.queries import QUERIES as CORE

QUERIES = {k: entry.queries()[k] for k in CORE}
#: Queries that run a model or multiply vectors in Python workers.
PYTHON = {"hash_embed", "refine_identity", "refine_batches", "search", "search_tasks", "search_thoughts",
          "search_pct", "suggested", "search_batch", "suggest_all",
          "search_approx", "search_pruned", "search_wide", "search_batch_wide", "suggest_wide", "tag_page", "update_thoughts", "reembed_tasks", "reembed_contacts", "reembed_home",
          "reembed_interactions"}
#: Small limited reports, numbered after their limit.
RANKED = {"recent", "recent_events", "by_any_tag", "by_date_range", "related_tags",
          "review_top_tags", "search", "search_tasks", "search_thoughts", "search_pct",
          "suggested", "search_wide", "tag_page"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    python = re.search(r"ArrowEvalPython|MapInArrow|PythonUDF|BatchEvalPython", plan)
    assert bool(python) == (name in PYTHON), "Python only where a model or a matrix is needed"
    if name in RANKED:
        assert "TakeOrderedAndProject" in plan
    for line, above in _single_partitions(plan):
        # Only what the tasks have combined or limited may meet in one place.
        assert re.search(r"Aggregate|TakeOrdered|Limit", above) and name not in LISTS, line


#: Whole lists, ordered by range, never in one task.
LISTS = {"list_tasks", "list_contacts", "list_home", "items_by_tag", "review_entries"}


def _single_partitions(plan):
    """Exchanges into one partition, each with the operator right below it."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next((x for x in lines[i + 1:] if re.search(r"[A-Za-z]", x)), "")
            yield line, below


RANKED_LISTS = ["list_tasks_ranked", "list_contacts_ranked", "list_home_ranked",
                "items_by_tag_ranked", "review_entries_ranked"]


@pytest.mark.parametrize("name", RANKED_LISTS)
def test_ranks_need_no_single_task(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


HASHED = ["update_tasks", "updated_tasks", "update_contacts", "update_home", "update_thoughts",
          "needs_reembed", "latest_rows", "merge_task_changes", "last_contacts", "review_top_tags"]


@pytest.mark.parametrize("name", HASHED)
def test_keyed_changes_are_hashed(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_only_touched_rows_pass_the_model(spark, sf_dir):
    """The model stands above a filter on the rows whose text is given."""
    for name in ("reembed_tasks", "reembed_interactions"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Union" in plan
        assert "ArrowEvalPython" in plan.split("Union")[1].split(":- ")[1]


@pytest.mark.parametrize("name, most", [("search_wide", 4), ("search_batch_wide", 5)])
def test_texts_are_embedded_once(spark, sf_dir, name, most):
    """One model call per table (and one for the queries), none again below a filter."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [embed_all") == most


def test_pairs_and_windows_combine_before_the_shuffle(spark, sf_dir):
    plan = QUERIES["related_all"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan
    assert re.search(r"WindowGroupLimit.*Partial", plan)
    assert plan.count("Exchange hashpartitioning(tag") >= 2
    plan = QUERIES["search_batch"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_texts_are_cut_once(spark, sf_dir):
    """The generator adds no filter that would cut every text a second time."""
    plan = QUERIES["chunk_sliding"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (size(" not in plan


def test_wide_vectors_are_made_in_many_tasks(spark, sf_dir, monkeypatch):
    """Narrow rows are dealt anew below the model, by their number and not by file splits."""
    from knowspark.plans import queries
    from knowspark.sources import tables
    monkeypatch.setattr(queries, "WIDE_ROWS", 40)
    store = queries.wide_store(spark, sf_dir)
    for name, source in queries.NARROW.items():
        plan = store.table(name)._jdf.queryExecution().executedPlan().toString()
        want = -(-tables.read_table(spark, sf_dir, source).count() // 40)
        assert "Exchange hashpartitioning(id" in plan.split("ArrowEvalPython [embed_all")[1]
        assert store.table(name).rdd.getNumPartitions() == want > 1


def test_a_task_holds_one_part(spark, sf_dir):
    """Parts go to tasks by number: no two meet in one, as hashes of numbers do."""
    from pyspark.sql import functions as F
    from knowspark.operators import search
    parts = 40
    items = spark.range(400).select(
        (F.col("id") % parts).alias("part"), F.concat(F.lit("i"), "id").alias("id"),
        F.array(F.lit(1.0), F.col("id")).cast("array<float>").alias("embedding"),
        F.lit(None).cast("array<string>").alias("tags"))
    asked = spark.range(parts).select(
        F.col("id").alias("part"), F.concat(F.lit("q"), "id").alias("id"),
        F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    hits = search.nearest_in_parts(items, asked, 1, parts).withColumn("task", F.spark_partition_id())
    found = hits.select("task", "query_id").collect()
    assert len(found) == parts and len({r["task"] for r in found}) == parts
