"""Table schemas, closed value sets, limits and defaults of the knowledge store."""

from pyspark.sql import types as T

_TAGS = T.ArrayType(T.StringType(), True)
_VECTOR = T.ArrayType(T.FloatType(), True)


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


THOUGHTS = _struct(
    ("id", T.StringType(), False),
    ("content", T.StringType(), False),
    ("embedding", _VECTOR, True),
    ("source", T.StringType(), True),
    ("content_type", T.StringType(), True),
    ("title", T.StringType(), True),
    ("tags", _TAGS, True),
    ("metadata", T.StringType(), True),
    ("chunk_index", T.IntegerType(), True),
    ("parent_id", T.StringType(), True),
    ("created_at", T.TimestampType(), True),
    ("updated_at", T.TimestampType(), True),
)

TASKS = _struct(
    ("id", T.StringType(), False),
    ("title", T.StringType(), False),
    ("notes", T.StringType(), True),
    ("status", T.StringType(), True),
    ("priority", T.StringType(), True),
    ("due_date", T.DateType(), True),
    ("recurrence_days", T.IntegerType(), True),
    ("category", T.StringType(), True),
    ("tags", _TAGS, True),
    ("embedding", _VECTOR, True),
    ("created_at", T.TimestampType(), True),
    ("updated_at", T.TimestampType(), True),
)

CONTACTS = _struct(
    ("id", T.StringType(), False),
    ("name", T.StringType(), False),
    ("email", T.StringType(), True),
    ("phone", T.StringType(), True),
    ("company", T.StringType(), True),
    ("last_contact_at", T.TimestampType(), True),
    ("notes", T.StringType(), True),
    ("tags", _TAGS, True),
    ("embedding", _VECTOR, True),
    ("created_at", T.TimestampType(), True),
    ("updated_at", T.TimestampType(), True),
)

HOME_ITEMS = _struct(
    ("id", T.StringType(), False),
    ("name", T.StringType(), False),
    ("notes", T.StringType(), True),
    ("last_done_at", T.TimestampType(), True),
    ("next_due_at", T.TimestampType(), True),
    ("interval_days", T.IntegerType(), True),
    ("tags", _TAGS, True),
    ("embedding", _VECTOR, True),
    ("created_at", T.TimestampType(), True),
    ("updated_at", T.TimestampType(), True),
)

TABLES = {
    "thoughts": THOUGHTS,
    "tasks": TASKS,
    "contacts": CONTACTS,
    "home_items": HOME_ITEMS,
}

#: Request form of one thing to ingest; entry_id makes retries idempotent.
ENTRIES = _struct(
    ("entry_id", T.StringType(), True),
    ("content", T.StringType(), True),
    ("content_type", T.StringType(), True),
    ("title", T.StringType(), True),
    ("tags", _TAGS, True),
    ("source", T.StringType(), True),
    ("metadata", T.StringType(), True),
)

# --- Fixed values: closed sets, length limits, defaults, updatable columns ---
CONTENT_TYPES = ("thought", "note", "event")
TASK_STATUSES = ("open", "done", "cancelled")
TASK_PRIORITIES = ("high", "medium", "low")
TASK_CATEGORIES = ("general", "work", "personal", "health", "finance", "home")
ITEM_TYPE_ORDER = ("thought", "note", "event", "task", "contact", "home_item")

MAX_CONTENT = 50_000
MAX_TASK_TITLE = 500
MAX_CONTACT_NAME = 200
MAX_HOME_NAME = 300
MAX_INTERACTION_NOTE = 5_000
EMBEDDING_DIMS = 384

DEFAULTS = {
    "thoughts": {"source": "api", "content_type": "thought", "tags": [], "metadata": "{}",
                 "chunk_index": 0},
    "tasks": {"status": "open", "priority": "medium", "category": "general", "tags": []},
    "contacts": {"tags": []},
    "home_items": {"tags": []},
}

UPDATABLE = {
    "thoughts": ("content", "title", "tags", "metadata"),
    "tasks": ("title", "notes", "status", "priority", "due_date", "recurrence_days",
              "category", "tags"),
    "contacts": ("name", "email", "phone", "company", "notes", "tags"),
    "home_items": ("name", "notes", "interval_days", "next_due_at", "tags"),
}

#: The columns whose text is embedded, in order.
EMBEDDED_TEXT = {
    "thoughts": ("content",),
    "tasks": ("title", "notes"),
    "contacts": ("name", "notes"),
    "home_items": ("name", "notes"),
}
# --- end of fixed values ---
