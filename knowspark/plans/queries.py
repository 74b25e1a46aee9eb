"""Every operator as a named query over the given tables.

Results are flat: arrays become text, instants ISO text, similarities are
rounded for comparison. Only reports that are limited by nature have a limit.
"""

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knowspark.functions import labels, text, times, vectors
from knowspark.operators import (
    agenda, changes, ingest, items, notes, refining, review, search, tags,
    vector_index)
from knowspark.plans import reports
from knowspark.session import new_work_path
from knowspark.sources import tables
from knowspark.sources.notes import read_entries_json, read_text_notes
from knowspark.sources.store import (
    Store, latest_rows, merge_changes, read_store, write_store)
from knowspark.streaming import jobs
from knowspark.streaming.versions import VersionedTable

#: The present for tasks, contacts and home items, and for thoughts.
AS_OF = "2001-07-20"
THOUGHTS_AS_OF = "2024-01-12"
TAG = "topic-3"

#: Partitions that texts are dealt over before heavy work; the benchmark sets it,
#: whose files have one row group each. None: as the scan splits them.
PARTITIONS = None

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def on_store(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tables.load(spark, sf_dir))
    QUERIES[function.__name__] = run
    return function


def on_texts(function):
    """For work that is heavy per text."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(tables.thoughts(spark, sf_dir, PARTITIONS))
    QUERIES[function.__name__] = run
    return function


def iso(column: str):
    return times.to_iso(column).alias(column)


def tag_text(column: str = "tags"):
    return F.array_join(column, "|").alias(column)


def day(column: str):
    return F.col(column).cast("string").alias(column)


def sim(column: str = "similarity"):
    return F.round(column, 6).alias(column)


def ranked(df: DataFrame, *order) -> DataFrame:
    """Adds the position in an ordered report; only for limited results."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


# Sources ---------------------------------------------------------------------


@query
def store_round_trip(spark, sf_dir):
    """All four tables written as a snapshot and read back, row by row."""
    root = new_work_path(spark, "store")
    loaded = tables.load(spark, sf_dir)
    for name in Store.table_names():
        write_store(loaded.table(name), root, name)
    stored = read_store(spark, root)
    shown = {"thoughts": ("content", "title"), "tasks": ("title", "notes"),
             "contacts": ("name", "notes"), "home_items": ("name", "notes")}
    rows = [stored.table(name).select(
        F.lit(name).alias("table"), "id", F.col(first).alias("first"), F.col(second).alias("second"),
        tag_text(), iso("created_at"), F.size("embedding").alias("dims"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
        .alias("total")) for name, (first, second) in shown.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query
def read_entries(spark, sf_dir):
    """Entries written as JSON lines and read back with the entry schema."""
    path = new_work_path(spark, "entries")
    tables.entries(spark, sf_dir, PARTITIONS).drop("created_at").write.json(path)
    return read_entries_json(spark, path).select(
        "entry_id", "content", "content_type", "title", tag_text(), "source", "metadata")


@query
def items_by_tag_index(spark, sf_dir):
    """Tag lookup served from a written tag index."""
    path = new_work_path(spark, "tag-index")
    items.write_tag_index(tables.load(spark, sf_dir), path)
    return items.items_by_tag_indexed(spark, path, TAG).select(
        "id", "content", "title", tag_text(), "content_type", iso("created_at"))


# Ingest ------------------------------------------------------------------------


def _reasons():
    return F.array_join("reject_reasons", "; ").alias("reasons")


@query
def validate_entries(spark, sf_dir):
    checked = ingest.check(tables.entries(spark, sf_dir, PARTITIONS), "entries")
    return checked.select("entry_id", F.length("content").alias("n"), "content_type", _reasons())


@query
def validate_tasks(spark, sf_dir):
    raw = tables.read_table(spark, sf_dir, "orders").selectExpr(
        "concat('t', o_orderkey) AS id",
        "CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN repeat('x', 501) "
        "WHEN o_orderkey % 17 <> 0 THEN concat('Order ', o_orderkey) END AS title",
        "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END "
        "AS status",
        "lower(substr(o_orderpriority, 3)) AS priority",
        "CASE WHEN o_orderkey % 7 <> 0 THEN 'work' END AS category")
    return ingest.check(raw, "tasks").select("id", _reasons())


@query
def validate_contacts(spark, sf_dir):
    raw = tables.read_table(spark, sf_dir, "customer").selectExpr(
        "concat('c', c_custkey) AS id",
        "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN repeat(c_name, 12) "
        "ELSE c_name END AS name")
    return ingest.check(raw, "contacts").select("id", _reasons())


@query
def validate_home(spark, sf_dir):
    raw = tables.read_table(spark, sf_dir, "part").selectExpr(
        "concat('h', p_partkey) AS id",
        "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN repeat(p_name, 40) "
        "ELSE p_name END AS name")
    return ingest.check(raw, "home_items").select("id", _reasons())


@query
def validate_interactions(spark, sf_dir):
    raw = tables.interactions(spark, sf_dir).withColumn("note", F.expr(
        "CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN repeat(note, 900) "
        "WHEN event_id % 19 <> 0 THEN note END"))
    return ingest.check(raw, "interactions").select("event_id", _reasons())


@query
def validate_updates(spark, sf_dir):
    """Changes of tasks, where NULL keeps a value."""
    return ingest.check(
        task_changes(spark, sf_dir).withColumn("title", F.expr(
            "CASE WHEN version % 11 = 0 THEN '' ELSE title END")), "tasks", update=True) \
        .select("id", "version", _reasons())


@query
def read_notes(spark, sf_dir):
    """Documents of each language and source written as one text file, read as notes."""
    path = new_work_path(spark, "notes")
    tables.read_table(spark, sf_dir, "documents").select("text", "lang", "source", "doc_id") \
        .repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id") \
        .select("text", "lang", "source").write.partitionBy("lang", "source").text(path)
    return read_text_notes(spark, path).select(
        F.md5("content").alias("digest"), F.length("content").alias("n"), "content_type", "source",
        tag_text())


@query
def read_nameless_entries(spark, sf_dir):
    """Entries without ids, some of them twice: each gets an id of its own."""
    path = new_work_path(spark, "nameless")
    entries = tables.entries(spark, sf_dir, PARTITIONS).drop("created_at", "entry_id")
    entries.unionByName(entries.filter("length(content) % 3 = 0")).write.json(path)
    return read_entries_json(spark, path).groupBy("content_type").agg(
        F.count("*").alias("n"), F.countDistinct("entry_id").alias("ids"))


@query
def apply_defaults(spark, sf_dir):
    raw = tables.read_table(spark, sf_dir, "orders").selectExpr(
        "concat('t', o_orderkey) AS id",
        "CASE o_orderstatus WHEN 'F' THEN 'done' END AS status",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' END AS priority")
    return ingest.apply_defaults(raw, "tasks").select(
        "id", "status", "priority", "category", F.size("tags").alias("n_tags"))


def _chunks(df):
    return df.select("id", "chunk_index", "total_chunks", "text")


@on_texts
def chunk_all(thoughts):
    return _chunks(ingest.chunk(thoughts))


@on_texts
def chunk_notes(thoughts):
    return _chunks(ingest.chunk(thoughts.withColumn("content_type", F.lit("note"))))


@query
def chunk_sliding(spark, sf_dir):
    return _chunks(ingest.chunk(tables.long_notes(spark, sf_dir, PARTITIONS)))


@query
def chunk_windows(spark, sf_dir):
    """Word windows of another size over every document."""
    docs = tables.long_notes(spark, sf_dir, PARTITIONS)
    return _chunks(ingest.chunk_sliding(docs, size=120, overlap=30))


def _ingested(rows, *more):
    return rows.select(
        "id", "parent_id", "chunk_index", "content", "content_type", "title", tag_text(),
        "source", "metadata", iso("created_at"), *more)


@query
def ingest_rows(spark, sf_dir):
    valid, _ = ingest.validate(tables.entries(spark, sf_dir, PARTITIONS), "entries")
    return _ingested(ingest.ingest(valid))


@query
def ingest_summary(spark, sf_dir):
    valid, _ = ingest.validate(tables.entries(spark, sf_dir, PARTITIONS), "entries")
    return ingest.ingest_summary(valid)


@query
def ingest_totals(spark, sf_dir):
    valid, _ = ingest.validate(tables.entries(spark, sf_dir, PARTITIONS), "entries")
    return ingest.ingest_totals(valid)


@on_texts
def hash_embed(thoughts):
    """Bucket weights of every thought's embedding."""
    embedded = ingest.embed(thoughts.select("id", "content"), "content")
    return embedded.select("id", F.posexplode_outer("embedding").alias("bucket", "w")) \
        .filter(F.col("w") != 0) \
        .select("id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))


@query
def vector_text(spark, sf_dir):
    """Vectors written as text and parsed again."""
    stored = tables.read_table(spark, sf_dir, "embeddings")
    back = vectors.parse_vector(vectors.format_vector("embedding"))
    return stored.select(
        "vec_id", F.size(back).alias("dims"), (back == F.col("embedding")).alias("same"),
        F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
        .alias("total"))


@query
def json_field(spark, sf_dir):
    events = tables.read_table(spark, sf_dir, "events")
    return events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def refine_post(spark, sf_dir):
    answers = tables.read_table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 10 = 0 THEN ' \\t' ELSE concat(' ', p_name, '\\n') END "
        "AS content",
        "CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE concat(p_brand, ' ') END AS title",
        "array(p_name, p_brand, concat('#', p_name), p_type, concat('Size ', p_size), '!', "
        "concat(p_type, '_', p_size), concat('p-', p_partkey)) AS tags")
    return ingest.refine_postprocess(answers).select(
        "p_partkey", "content", "title", tag_text(), F.col("refine_error").alias("error"))


@query
def refine_identity(spark, sf_dir):
    """Documents through the identity backend and the post-processing."""
    docs = tables.entries(spark, sf_dir, PARTITIONS).select("entry_id", "content", "content_type")
    return ingest.refine(docs).select("entry_id", "content", "title", tag_text(), "refine_error")


@query
def refine_batches(spark, sf_dir):
    """Documents through a backend that takes batches and refuses some types."""
    docs = tables.entries(spark, sf_dir, PARTITIONS).select("entry_id", "content", "content_type")
    return refining.refine_batches(docs, retries=0).select(
        "entry_id", "content", "title", tag_text(), "refine_error")


# Filters and lists -------------------------------------------------------------


def _thought_rows(df):
    out = ranked(df, F.desc("created_at"), "id")
    return out.select("rank", "id", "content", "title", tag_text(), "content_type", "source",
                      iso("created_at"))


@on_store
def recent(store):
    return _thought_rows(review.recent(store, 10))


@on_store
def recent_events(store):
    return _thought_rows(review.recent(store, 25, "event"))


@on_store
def by_any_tag(store):
    return _thought_rows(review.by_any_tag(store, [TAG, "de"], 20))


@on_store
def by_date_range(store):
    return _thought_rows(review.by_date_range(
        store, "2024-01-01T12:20:00Z", "2024-01-03T12:00:00+00:00", None, 100))


@on_store
def unified_items(store):
    return items.unified_items(store).select(
        "id", "content", "title", tag_text(), "content_type", iso("created_at"))


@on_store
def items_by_tag(store):
    return items.items_by_tag(store, TAG).select(
        "id", "content", "title", tag_text(), "content_type", iso("created_at"))


@on_store
def items_by_tag_ranked(store):
    return items.items_by_tag(store, TAG, rank=True).select(
        "rank", "id", "content", "title", tag_text(), "content_type", iso("created_at"))


@on_store
def items_by_type(store):
    return items.items_by_type(items.items_by_tag(store, TAG))


@on_store
def display_text(store):
    return items.unified_items(store).select(
        "id", labels.display_text("title", "content").alias("text"))


def _task_rows(df):
    return df.select(
        labels.priority_rank("priority").alias("priority_rank"), "id", "title", "notes", "status",
        "priority", day("due_date"), "recurrence_days", "category", tag_text(), iso("created_at"))


@on_store
def list_tasks(store):
    return _task_rows(agenda.list_tasks(store, AS_OF))


@on_store
def list_tasks_due(store):
    return _task_rows(agenda.list_tasks(store, AS_OF, "open", "work", 7))


@on_store
def list_tasks_ranked(store):
    """All tasks with their place; every tenth has no due date."""
    return agenda.list_tasks(store, AS_OF, rank=True).select(
        "rank", "id", "priority", day("due_date"))


@on_store
def list_contacts_ranked(store):
    return agenda.list_contacts(store, AS_OF, rank=True).select("rank", "id", iso("last_contact_at"))


@on_store
def list_home_ranked(store):
    return agenda.list_home_items(store, AS_OF, rank=True).select("rank", "id", iso("next_due_at"))


def _contact_rows(df):
    return df.select("id", "name", "email", "phone", "company", iso("last_contact_at"), "notes",
                     tag_text(), iso("created_at"))


@on_store
def list_contacts(store):
    return _contact_rows(agenda.list_contacts(store, AS_OF, 30))


def _home_rows(df):
    return df.select("id", "name", "notes", iso("last_done_at"), iso("next_due_at"),
                     "interval_days", tag_text(), iso("created_at"))


@on_store
def list_home(store):
    return _home_rows(agenda.list_home_items(store, AS_OF, 7))


@on_store
def overdue_tasks(store):
    return _task_rows(agenda.overdue_tasks(store, AS_OF))


@on_store
def due_soon_tasks(store):
    return _task_rows(agenda.due_soon_tasks(store, AS_OF))


@on_store
def overdue_home(store):
    return _home_rows(agenda.overdue_home(store, AS_OF))


@on_store
def due_soon_home(store):
    return _home_rows(agenda.due_soon_home(store, AS_OF))


@on_store
def contacts_to_reach(store):
    return _contact_rows(agenda.contacts_to_reach(store, AS_OF))


@on_store
def stale_days(store):
    return agenda.stale_contacts_days(store, AS_OF).select("id", "name", "days")


@on_store
def contacts_by_name(store):
    return _contact_rows(agenda.contacts_by_name(store, " CUSTOMER#0000001"))


@on_store
def dashboard(store):
    return agenda.dashboard_rows(store, AS_OF)


@query
def lookup(spark, sf_dir):
    """Tasks of all orders with a returned line."""
    returned = tables.read_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'") \
        .select(F.concat(F.lit("t"), F.col("l_orderkey")).alias("id"))
    return _task_rows(items.lookup(tables.tasks(spark, sf_dir), returned))


@query
def lookup_reduced(spark, sf_dir):
    """Tasks of all orders with a large returned line, by a bitmap of their ids."""
    returned = tables.read_table(spark, sf_dir, "lineitem") \
        .filter("l_returnflag = 'R' AND l_quantity > 45") \
        .select(F.concat(F.lit("t"), F.col("l_orderkey")).alias("id"))
    return _task_rows(items.lookup(tables.tasks(spark, sf_dir), returned, reduce=True))


@on_store
def get_rows(store):
    return _task_rows(items.get_rows(store.tasks, ["t1", "t7", "t32", "none"]))


# Tags --------------------------------------------------------------------------


@on_store
def tag_counts(store):
    return tags.tag_counts(store)


@on_store
def tags_matching(store):
    return tags.tags_matching(store, "TOPIC-1")


@on_store
def related_tags(store):
    return ranked(tags.related_tags(store, TAG), F.desc("co_occurrence"), "tag")


@on_store
def tag_pairs(store):
    return tags.tag_pairs(store)


@on_store
def related_all(store):
    return tags.related_all(store)


def _centroid_rows(df):
    return df.select("tag", "n", F.posexplode_outer("centroid").alias("dim", "v")) \
        .select("tag", "n", "dim", F.round("v", 6).alias("mean"))


@on_store
def tag_centroid(store):
    return _centroid_rows(tags.tag_centroid(store, TAG))


@on_store
def tag_centroids(store):
    return _centroid_rows(tags.tag_centroids(store))


# Statistics and review ---------------------------------------------------------


@on_store
def stats_by_type(store):
    return review.stats_by_type(store)


@on_store
def stats_total(store):
    return review.stats_total(store).select("total", iso("most_recent"))


@on_store
def stats_range(store):
    return review.stats_range(store).select("total", iso("oldest"), iso("newest"))


@on_store
def review_entries(store):
    return review.review_entries(store, THOUGHTS_AS_OF).select(
        "id", "content", "title", tag_text(), "content_type", iso("created_at"))


@on_store
def review_entries_ranked(store):
    return review.review_entries(store, THOUGHTS_AS_OF, rank=True).select(
        "rank", "id", "content", "title", tag_text(), "content_type", iso("created_at"))


@on_store
def review_total(store):
    return review.review_total(store, THOUGHTS_AS_OF)


@on_store
def review_by_type(store):
    return review.review_by_type(store, THOUGHTS_AS_OF)


@on_store
def review_top_tags(store):
    return review.review_top_tags(store, THOUGHTS_AS_OF)


# Notes and interactions --------------------------------------------------------


@query
def reassemble(spark, sf_dir):
    return notes.reassemble(tables.chunk_rows(spark, sf_dir)).select(
        "id", "content", "title", tag_text(), "content_type", iso("created_at"), "total_chunks")


@query
def thoughts_full(spark, sf_dir):
    """Every conversation row asked for by its id, parents and chunks alike."""
    rows = tables.chunk_rows(spark, sf_dir)
    return notes.thoughts_full(rows, rows.select("id")).select(
        "id", "content", "title", tag_text(), "content_type", iso("created_at"), "total_chunks")


def _logged(spark, sf_dir):
    return changes.log_interactions(
        tables.contacts(spark, sf_dir), tables.interactions(spark, sf_dir))


@query
def log_interactions(spark, sf_dir):
    return _logged(spark, sf_dir).select("id", "notes", iso("last_contact_at"), iso("updated_at"))


@query
def parse_notes(spark, sf_dir):
    return notes.parse_notes(_logged(spark, sf_dir)).select(
        "id", "profile", F.size("interactions").alias("n"),
        F.array_join(F.transform("interactions", lambda r: F.concat(
            r["date"], F.lit("|"), r["content"])), "\n").alias("interactions"))


@query
def interactions_of(spark, sf_dir):
    return notes.interactions_of(_logged(spark, sf_dir))


@query
def last_contacts(spark, sf_dir):
    events = tables.interactions(spark, sf_dir)
    again = events.unionByName(events.filter("event_id % 3 = 0"))  # delivered twice
    return changes.last_contacts(again).select(
        "contact_id", iso("last_contact_at"), "interactions")


# Scalar functions --------------------------------------------------------------


@on_store
def embed_text(store):
    return store.contacts.select("id", text.embed_text("name", "notes", "email").alias("text"))


@query
def normalize_tag(spark, sf_dir):
    parts = tables.read_table(spark, sf_dir, "part")
    return parts.select(
        "p_partkey", text.normalize_tag("p_name").alias("name_tag"),
        text.normalize_tag("p_type").alias("type_tag"),
        text.normalize_tag(F.repeat("p_brand", F.lit(9))).alias("long_tag"))


@query
def clean_tags(spark, sf_dir):
    """Every document's words as raw tags: the form keeps twenty."""
    docs = tables.read_table(spark, sf_dir, "documents", PARTITIONS)
    return docs.select(
        "doc_id", F.array_join(text.clean_tags(text.words("text")), "|").alias("tags"))


@on_texts
def detect_type(thoughts):
    return thoughts.select("id", text.detect_type("content").alias("detected"))


@on_store
def rel_time(store):
    return store.thoughts.select(
        "id", labels.rel_time("created_at", "2024-01-12T06:30:00Z").alias("short"),
        labels.rel_time("created_at", "2024-06-01", months=True).alias("long"))


@query
def parse_iso(spark, sf_dir):
    """Instants written as ISO text and read again."""
    events = tables.read_table(spark, sf_dir, "events").withColumn("text", times.to_iso("ts"))
    return events.select("event_id", times.to_iso(times.parse_iso("text")).alias("ts"))


@on_store
def task_due_label(store):
    return store.tasks.select(
        "id", labels.task_due_label("due_date", AS_OF).alias("label"),
        labels.is_overdue("due_date", "status", AS_OF).alias("overdue"))


@on_store
def home_due_label(store):
    return store.home_items.select(
        "id", labels.home_due_label("next_due_at", "2001-07-20T06:00:00").alias("label"),
        labels.home_due_class("next_due_at", "2001-07-20T06:00:00").alias("class"))


@on_store
def last_contact_label(store):
    return store.contacts.select(
        "id", times.days_since("last_contact_at", AS_OF).alias("days"),
        labels.last_contact_label("last_contact_at", AS_OF).alias("label"))


@on_store
def initials(store):
    return items.unified_items(store).select(
        "id", labels.initials("title").alias("initials"))


@on_store
def contact_details(store):
    return store.contacts.select(
        "id", labels.contact_details("email", "phone", "company").alias("details"))


# Changes -----------------------------------------------------------------------


def _lines(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "lineitem")


#: Day of shipping; later lines change the task later.
SHIPPED = "CAST(datediff(l_shipdate, DATE '1995-01-01') AS BIGINT)"


def task_changes(spark, sf_dir):
    """Each order line as a change of the order's task."""
    return _lines(spark, sf_dir).selectExpr(
        "concat('t', l_orderkey) AS id",
        f"{SHIPPED} * 100000000000000 + l_partkey * 10000000 + l_suppkey * 10 + l_linenumber "
        "AS version",
        "CASE WHEN l_returnflag = 'R' THEN concat('Returned ', l_partkey) END AS title",
        "CASE WHEN l_linestatus = 'F' THEN concat(l_returnflag, ' ', l_partkey) END AS notes",
        "CASE WHEN l_linestatus = 'F' THEN 'done' END AS status",
        "CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity < 5 THEN 'low' END AS priority",
        "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) END AS due_date",
        "CASE WHEN l_returnflag = 'A' THEN array('returned', l_linestatus) END AS tags")


def _task_state(df):
    return df.select("id", "title", "notes", "status", "priority", day("due_date"), "category",
                     tag_text(), iso("updated_at"))


@query
def update_tasks(spark, sf_dir):
    return _task_state(changes.apply_updates(
        tables.tasks(spark, sf_dir), task_changes(spark, sf_dir), "tasks", AS_OF))


@query
def updated_tasks(spark, sf_dir):
    return _task_state(changes.updated_rows(
        tables.tasks(spark, sf_dir), task_changes(spark, sf_dir), "tasks", AS_OF))


@query
def update_contacts(spark, sf_dir):
    given = tables.read_table(spark, sf_dir, "orders").selectExpr(
        "concat('c', o_custkey) AS id", "o_orderkey AS version",
        "CASE WHEN o_orderstatus = 'P' THEN concat('phone-', o_orderkey) END AS phone",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS company")
    return changes.apply_updates(tables.contacts(spark, sf_dir), given, "contacts", AS_OF).select(
        "id", "name", "phone", "company", iso("updated_at"))


@query
def update_home(spark, sf_dir):
    given = _lines(spark, sf_dir).selectExpr(
        "concat('h', l_partkey) AS id",
        f"({SHIPPED} * 100000000 + l_orderkey) * 100000 + l_suppkey * 10 + l_linenumber "
        "AS version",
        "CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS interval_days",
        "CASE WHEN l_linestatus = 'O' THEN concat('order ', l_orderkey) END AS notes")
    return changes.apply_updates(
        tables.home_items(spark, sf_dir), given, "home_items", AS_OF).select(
        "id", "name", "notes", "interval_days", iso("updated_at"))


@query
def update_thoughts(spark, sf_dir):
    """Labels as changes: toxic texts are replaced and embedded again."""
    given = tables.read_table(spark, sf_dir, "labels").selectExpr(
        "concat('d', doc_id) AS id", "quality AS version",
        "CASE WHEN toxic = 1 THEN '[removed]' END AS content",
        "CASE WHEN quality = 1 THEN concat('Good ', doc_id) END AS title",
        "CASE WHEN toxic = 1 THEN array('flagged') END AS tags")
    done = changes.update_thoughts(
        tables.thoughts(spark, sf_dir), given, THOUGHTS_AS_OF,
        make_embedder=partial(ingest.HashEmbedder, 64))
    return done.select(
        "id", "content", "title", tag_text(), iso("updated_at"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("top_weight"))


EMBEDDER = partial(ingest.HashEmbedder, 64)


def _top_weight(df):
    return df.select("id", F.round(F.array_max("embedding").cast("double"), 6).alias("top_weight"))


@query
def reembed_tasks(spark, sf_dir):
    """Tasks after all changes; those whose text is given get a new vector."""
    return _top_weight(changes.apply_updates(
        tables.tasks(spark, sf_dir), task_changes(spark, sf_dir), "tasks", AS_OF,
        make_embedder=EMBEDDER))


@query
def reembed_contacts(spark, sf_dir):
    given = tables.read_table(spark, sf_dir, "orders").selectExpr(
        "concat('c', o_custkey) AS id", "o_orderkey AS version",
        "CASE WHEN o_orderstatus = 'F' THEN concat('order ', o_orderkey) END AS notes")
    return _top_weight(changes.apply_updates(
        tables.contacts(spark, sf_dir), given, "contacts", AS_OF, make_embedder=EMBEDDER))


@query
def reembed_home(spark, sf_dir):
    given = _lines(spark, sf_dir).selectExpr(
        "concat('h', l_partkey) AS id",
        f"({SHIPPED} * 100000000 + l_orderkey) * 100000 + l_suppkey * 10 + l_linenumber "
        "AS version",
        "CASE WHEN l_linestatus = 'O' THEN concat('order ', l_orderkey) END AS notes")
    return _top_weight(changes.apply_updates(
        tables.home_items(spark, sf_dir), given, "home_items", AS_OF, make_embedder=EMBEDDER))


@query
def reembed_interactions(spark, sf_dir):
    """Contacts whose notes grew by interactions are embedded again."""
    return _top_weight(changes.log_interactions(
        tables.contacts(spark, sf_dir), tables.interactions(spark, sf_dir), EMBEDDER))


@query
def needs_reembed(spark, sf_dir):
    return changes.needs_reembed(
        tables.tasks(spark, sf_dir), task_changes(spark, sf_dir), "tasks")


@query
def delete_tasks(spark, sf_dir):
    gone = _lines(spark, sf_dir).filter("l_returnflag = 'R'").select(
        F.concat(F.lit("t"), F.col("l_orderkey")).alias("id"))
    return changes.delete_rows(tables.tasks(spark, sf_dir), gone).select("id", "title", "status")


@query
def delete_tasks_reduced(spark, sf_dir):
    gone = _lines(spark, sf_dir).filter("l_returnflag = 'R'").select(
        F.concat(F.lit("t"), F.col("l_orderkey")).alias("id"))
    return changes.delete_rows(tables.tasks(spark, sf_dir), gone, reduce=True).select(
        "id", "title", "status")


@query
def delete_thoughts_reduced(spark, sf_dir):
    rows = tables.chunk_rows(spark, sf_dir)
    gone = rows.filter(F.length("content") > 150).select("id")
    return changes.delete_thoughts(rows, gone, reduce=True).select("id", "parent_id", "chunk_index")


@query
def delete_thoughts(spark, sf_dir):
    """Conversations whose first turn is long go with all turns; long later
    turns, named by their own id, stay."""
    rows = tables.chunk_rows(spark, sf_dir)
    return changes.delete_thoughts(rows, rows.filter(F.length("content") > 150).select("id")) \
        .select("id", "parent_id", "chunk_index")


def task_completions(spark, sf_dir):
    """Each order line as a completion of the order's task."""
    return _lines(spark, sf_dir).selectExpr(
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS event_id",
        "concat('t', l_orderkey) AS id")


@query
def complete_tasks(spark, sf_dir):
    return _task_state(changes.complete_tasks(
        tables.tasks(spark, sf_dir), task_completions(spark, sf_dir), AS_OF))


@query
def next_tasks(spark, sf_dir):
    return _task_rows(changes.next_tasks(
        tables.tasks(spark, sf_dir), task_completions(spark, sf_dir), AS_OF))


@query
def complete_home(spark, sf_dir):
    events = _lines(spark, sf_dir).selectExpr(
        "concat('h', l_partkey) AS id", "timestampadd(DAY, l_linenumber, l_shipdate) AS ts")
    return _home_rows(changes.complete_home(tables.home_items(spark, sf_dir), events))


def _changed_tasks(spark, sf_dir):
    """Tasks, and the rows that change, written: both sides of a join read them."""
    base = tables.tasks(spark, sf_dir)
    newer = changes.updated_rows(base, task_changes(spark, sf_dir), "tasks", AS_OF)
    path = new_work_path(spark, "changed-tasks")
    newer.write.parquet(path)
    return base, spark.read.schema(newer.schema).parquet(path)


def latest_task_rows(spark, sf_dir):
    """Tasks as an append-only table: the rows as loaded and the changed rows."""
    base, newer = _changed_tasks(spark, sf_dir)
    versions = base.withColumn("version", F.lit(0)).unionByName(
        newer.withColumn("version", F.lit(1)))
    return _task_state(latest_rows(versions))


QUERIES["latest_rows"] = latest_task_rows


@query
def merge_task_changes(spark, sf_dir):
    """Tasks with their changed rows kept in a second table."""
    return _task_state(merge_changes(*_changed_tasks(spark, sf_dir)))


# Vector search -----------------------------------------------------------------


def _hits(df):
    out = ranked(df, F.desc("similarity"), "id")
    return out.select("rank", "id", "title", "content_type", tag_text(), sim())


@query
def cosine(spark, sf_dir):
    stored = tables.read_table(spark, sf_dir, "embeddings")
    zero = F.array(*[F.lit(v) for v in tables.query_vector(spark, sf_dir)])
    return stored.select("vec_id", F.round(
        vectors.cosine_similarity("embedding", zero), 6).alias("similarity"))


def search_items(spark, sf_dir):
    return _hits(search.search(
        tables.load(spark, sf_dir), tables.query_vector(spark, sf_dir), 10))


QUERIES["search"] = search_items


@query
def search_tasks(spark, sf_dir):
    return _hits(search.search(
        tables.load(spark, sf_dir), tables.query_vector(spark, sf_dir), 10, "task"))


@query
def search_thoughts(spark, sf_dir):
    found = search.search_thoughts(
        tables.load(spark, sf_dir), tables.query_vector(spark, sf_dir), 10)
    return ranked(found, F.desc("similarity"), "id").select("rank", "id", "source", sim())


@query
def search_pct(spark, sf_dir):
    found = search.search(
        tables.load(spark, sf_dir), tables.query_vector(spark, sf_dir, 1), 20)
    return ranked(found, F.desc("similarity"), "id").select(
        "rank", "id", labels.similarity_pct("similarity").alias("pct"))


@on_store
def suggested(store):
    return _hits(search.suggested_connections(store, TAG))


@on_store
def tag_page(store):
    """The three parts of a tag's page as one report."""
    page = reports.tag_page(store, TAG)
    related = ranked(page["related_tags"], F.desc("co_occurrence"), "tag")
    near = ranked(page["suggested"], F.desc("similarity"), "id")
    parts = [
        page["items"].select(F.lit("items").alias("section"), F.col("id").alias("key"),
                             F.lit(None).cast("int").alias("rank"),
                             F.lit(None).cast("double").alias("value")),
        related.select(F.lit("related"), "tag", "rank", F.col("co_occurrence").cast("double")),
        near.select(F.lit("suggested"), "id", "rank", sim())]
    return parts[0].union(parts[1]).union(parts[2])


def all_queries(spark, sf_dir):
    """Every stored vector as a query."""
    return tables.read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_grid(spark, sf_dir):
    """The grid for as many items as queries: every stored vector is one of either."""
    stored = tables.read_table(spark, sf_dir, "embeddings")
    items = stored.count()
    return search.grid_for(items, items, int(spark.conf.get("spark.sql.shuffle.partitions")),
                           search.vector_bytes(stored))


@query
def search_batch(spark, sf_dir):
    hits = search.search_batch(tables.load(spark, sf_dir), all_queries(spark, sf_dir), 10,
                               grid=vector_grid(spark, sf_dir))
    return hits.select("query_id", "rank", "id", sim())


@query
def search_batch_items(spark, sf_dir):
    """Hits of every stored vector among the contacts, with their attributes."""
    store = tables.load(spark, sf_dir)
    hits = search.search_batch(store, all_queries(spark, sf_dir), 5, content_type="contact",
                               grid=vector_grid(spark, sf_dir))
    return search.with_items(hits, store).select(
        "query_id", "rank", "id", "content", "title", "content_type", tag_text(), sim())


@query
def suggest_all(spark, sf_dir):
    return search.suggest_all(tables.load(spark, sf_dir), grid=vector_grid(spark, sf_dir)).select(
        "tag", "rank", "id", sim())


#: Rows of a table that one task embeds on average: 77 MB of vectors, and the tables that are
#: much narrower than their vectors, with the given table that has their rows.
WIDE_ROWS = 50_000
NARROW = {"tasks": "orders", "contacts": "customer", "home_items": "part"}


def wide_store(spark, sf_dir):
    """The store with a vector of full width on every item. Narrow rows are dealt over
    tasks first: a vector is many times the row it comes from, so a scan has too few
    splits to embed in, and to sort what is embedded."""
    loaded, wide = tables.load(spark, sf_dir), {}
    for name in Store.table_names():
        rows = loaded.table(name).drop("embedding")
        if name in NARROW:
            held = tables.read_table(spark, sf_dir, NARROW[name]).count()
            rows = rows.repartition(max(2, -(-held // WIDE_ROWS)), "id")
        wide[name] = ingest.embed_rows(rows, name)
    return Store(**wide)


def wide_queries(spark, sf_dir):
    """Every passage of the benchmark as a query."""
    return ingest.embed(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text", out="vector") \
        .select(F.col("item_id").alias("query_id"), "vector")


@query
def search_wide(spark, sf_dir):
    vector = wide_queries(spark, sf_dir).filter("query_id = 0").first()["vector"]
    return _hits(search.search(wide_store(spark, sf_dir), list(vector), 10))


@query
def search_batch_wide(spark, sf_dir):
    hits = search.search_batch(wide_store(spark, sf_dir), wide_queries(spark, sf_dir), 5)
    return hits.select("query_id", "rank", "id", sim())


@query
def suggest_wide(spark, sf_dir):
    """Items are asked for twice, for the centroids and to be found: embedded once."""
    root, wide = new_work_path(spark, "wide-store"), wide_store(spark, sf_dir)
    for name in Store.table_names():
        write_store(wide.table(name), root, name)
    return search.suggest_all(read_store(spark, root), 3).select("tag", "rank", "id", sim())


@query
def search_approx(spark, sf_dir):
    store = tables.load(spark, sf_dir)
    index = vector_index.build_index(store, new_work_path(spark, "vector-index"))
    hits = vector_index.search_approx(spark, index, all_queries(spark, sf_dir), 10)
    return hits.select("query_id", "rank", "id", sim())


@query
def search_pruned(spark, sf_dir):
    hits = vector_index.search_pruned(
        tables.load(spark, sf_dir), all_queries(spark, sf_dir), 10)
    return hits.select("query_id", "rank", "id", sim())


# Streaming ---------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    """A given table as a stream, be it one file or a folder of files. A pattern, as a
    stream that is given a plain file takes it for a folder."""
    return spark.readStream.schema(tables.SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parque[t]")


def _finish(started):
    started.awaitTermination()


@query
def stream_ingest(spark, sf_dir):
    root = new_work_path(spark, "stream-ingest")
    entries = tables.entry_columns(_stream(spark, sf_dir, "documents"))
    _finish(jobs.stream_ingest(entries, f"{root}/out", f"{root}/checkpoint", available_now=True,
                               make_embedder=partial(ingest.HashEmbedder, 64)))
    return _ingested(spark.read.parquet(f"{root}/out"), F.size("embedding").alias("dims"))


@query
def stream_last_contact(spark, sf_dir):
    root = new_work_path(spark, "stream-contact")
    events = tables.interaction_columns(_stream(spark, sf_dir, "events"))
    _finish(jobs.stream_last_contact(
        events, f"{root}/out", f"{root}/checkpoint", available_now=True))
    return jobs.read_last_contact(spark, f"{root}/out").select(
        "contact_id", iso("last_contact_at"), "interactions")


@query
def stream_activity(spark, sf_dir):
    root = new_work_path(spark, "stream-activity")
    thoughts = tables.thought_columns(_stream(spark, sf_dir, "documents")).withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    _finish(jobs.stream_activity(
        thoughts, f"{root}/out", f"{root}/checkpoint", available_now=True))
    return spark.read.parquet(f"{root}/out").select(iso("start"), iso("end"), "facet", "value", "n")


@query
def stream_activity_all(spark, sf_dir):
    """Windows kept up to date, open ones too, over notes and their chunk rows."""
    root = new_work_path(spark, "stream-activity-all")
    documents = tables.thought_columns(_stream(spark, sf_dir, "documents"))
    chunks = tables.chunk_columns(_stream(spark, sf_dir, "conversations"))
    columns = ("parent_id", "content_type", "tags",
               F.col("created_at").cast("timestamp").alias("created_at"))
    thoughts = documents.withColumn("parent_id", F.lit(None).cast("string")).select(*columns) \
        .unionByName(chunks.select(*columns))
    _finish(jobs.stream_activity_now(
        thoughts, f"{root}/out", f"{root}/checkpoint", delay="3650 days", available_now=True))
    return jobs.read_activity(spark, f"{root}/out").select(
        iso("start"), iso("end"), "facet", "value", "n")


@query
def stream_rejected(spark, sf_dir):
    root = new_work_path(spark, "stream-rejected")
    entries = tables.entry_columns(_stream(spark, sf_dir, "documents"))
    _finish(jobs.stream_rejected(entries, f"{root}/out", f"{root}/checkpoint", available_now=True))
    return spark.read.parquet(f"{root}/out").select("entry_id", _reasons())


@query
def stream_contacts(spark, sf_dir):
    """Contacts with the last contact that a stream of interactions keeps."""
    root = new_work_path(spark, "stream-contacts")
    events = tables.interaction_columns(_stream(spark, sf_dir, "events"))
    _finish(jobs.stream_last_contact(
        events, f"{root}/out", f"{root}/checkpoint", available_now=True))
    return changes.apply_last_contacts(
        tables.contacts(spark, sf_dir), jobs.read_last_contact(spark, f"{root}/out")).select(
        "id", "name", iso("last_contact_at"), iso("updated_at"))


@query
def stream_interactions(spark, sf_dir):
    """Contacts whose notes a stream keeps, week by week; the last batch runs twice."""
    root = new_work_path(spark, "stream-interactions")
    events = tables.interactions(spark, sf_dir)
    weeks = [f"2024-01-{d:02d}" for d in (1, 9, 17, 25)] + ["2025-01-01"]
    for since, until in zip(weeks[:-1], weeks[1:]):
        events.filter(f"ts >= timestamp_ntz'{since}' AND ts < timestamp_ntz'{until}'") \
            .coalesce(1).write.mode("append").parquet(f"{root}/in")
    contacts = VersionedTable(f"{root}/contacts", ("id",), fold=3)
    contacts.create(tables.contacts(spark, sf_dir))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{root}/in")
    _finish(jobs.stream_interactions(source, contacts, f"{root}/checkpoint", available_now=True))
    jobs.apply_interactions(contacts, events, contacts.applied(spark))
    return contacts.read(spark).select("id", "notes", iso("last_contact_at"), iso("updated_at"))


@query
def activity_daily(spark, sf_dir):
    """The same counts over a table with chunk rows, by day."""
    thoughts = tables.thoughts(spark, sf_dir).unionByName(
        tables.chunk_rows(spark, sf_dir), allowMissingColumns=True) \
        .withColumn("created_at", F.col("created_at").cast("timestamp"))
    return jobs.activity(thoughts, "created_at", "1 day").select(
        iso("start"), iso("end"), "facet", "value", "n")
