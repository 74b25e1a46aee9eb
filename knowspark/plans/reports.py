"""Reports made of several operators; each part is a DataFrame of its own."""

from pyspark.sql import functions as F

from knowspark.operators import agenda, items, review, search, tags
from knowspark.session import new_work_path
from knowspark.sources.store import Store


def tag_page(store: Store, tag: str) -> dict:
    """The tag's items, related tags and suggestions.

    The tagged items are found once and written to the work folder; all three
    parts read them there.
    """
    found = items.unified_items(store, embedding=True).filter(F.array_contains("tags", tag))
    path = new_work_path(found.sparkSession, "tagged")
    found.write.parquet(path)
    tagged = found.sparkSession.read.schema(found.schema).parquet(path)
    own = Store(tagged.withColumn("parent_id", F.lit(None).cast("string")),
                *(store.table(t).limit(0) for t in ("tasks", "contacts", "home_items")))
    return {
        "items": items.items_by_tag(own, tag),
        "related_tags": tags.related_tags(own, tag),
        "suggested": search.suggested_connections(store, tag, tagged=own),
    }


def dashboard(store: Store, as_of) -> dict:
    return agenda.dashboard(store, as_of)


def weekly_review(store: Store, as_of, days: int = 7) -> dict:
    return {
        "total": review.review_total(store, as_of, days),
        "by_type": review.review_by_type(store, as_of, days),
        "top_tags": review.review_top_tags(store, as_of, days),
        "entries": review.review_entries(store, as_of, days),
    }


def stats(store: Store) -> dict:
    return {
        "by_type": review.stats_by_type(store),
        "total": review.stats_total(store),
        "range": review.stats_range(store),
    }
