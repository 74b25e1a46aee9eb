"""Tag counts, co-occurrence and centroids over all four tables."""

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowspark.operators.items import parents, top
from knowspark.sources.store import Store


def tag_sets(store: Store, *columns) -> DataFrame:
    """The tag arrays of all items, with the given further columns."""
    tables = [parents(store.thoughts), store.tasks, store.contacts, store.home_items]
    return reduce(DataFrame.unionByName, [t.select("tags", *columns) for t in tables])


def tag_counts(store: Store) -> DataFrame:
    """How often each tag is used; a repeat inside one item counts again."""
    return (
        tag_sets(store).select(F.explode("tags").alias("tag"))
        .groupBy("tag").agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "tag")
    )


def tags_matching(store: Store, q: str) -> DataFrame:
    """Tags that contain the lower-cased text; blank text keeps all."""
    q = (q or "").lower()
    counts = tag_counts(store)
    return counts.filter(F.col("tag").contains(q)) if q else counts


def related_tags(store: Store, tag: str, k: int = 10) -> DataFrame:
    """Tags that occur together with the given one, most frequent first."""
    together = (
        tag_sets(store).filter(F.array_contains("tags", tag))
        .select(F.explode("tags").alias("tag")).filter(F.col("tag") != tag)
        .groupBy("tag").agg(F.count("*").alias("co_occurrence"))
    )
    return top(together, k, F.desc("co_occurrence"), "tag")


def tag_pairs(store: Store) -> DataFrame:
    """Co-occurrence counts of all ordered tag pairs.

    Two generators run inside the scan stage, one row of one item at a time, and
    the counts are combined before the only shuffle: each task sends a pair at
    most once, however common it is.
    """
    return (
        tag_sets(store)
        .select(F.explode_outer(F.array_distinct("tags")).alias("tag"), "tags")
        .filter(F.col("tag").isNotNull())
        .select("tag", F.explode("tags").alias("related"))
        .filter(F.col("tag") != F.col("related"))
        .groupBy("tag", "related").agg(F.count("*").alias("co_occurrence"))
    )


def related_all(store: Store, k: int = 10) -> DataFrame:
    """:func:`related_tags` of every tag; per-task top-k runs before the shuffle."""
    order = Window.partitionBy("tag").orderBy(F.desc("co_occurrence"), "related")
    return (
        tag_pairs(store).withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def _mean_vector():
    return vector_to_array(Summarizer.mean(F.col("_vector"))).alias("centroid")


def tag_centroids(store: Store) -> DataFrame:
    """Mean vector per tag: ``(tag, n, centroid)``.

    Each task keeps one running mean per tag and sends only that, so a tag that
    a third of all items carry costs no more than a rare one. An item that
    repeats a tag counts once.
    """
    return (
        tag_sets(store, "embedding").filter(F.col("embedding").isNotNull())
        .select(F.explode_outer(F.array_distinct("tags")).alias("tag"), "embedding")
        .filter(F.col("tag").isNotNull())
        .select("tag", array_to_vector("embedding").alias("_vector"))
        .groupBy("tag").agg(F.count("*").alias("n"), _mean_vector())
    )


def tag_centroid(store: Store, tag: str) -> DataFrame:
    """Mean vector of the tagged items; no row when none has a vector."""
    return (
        tag_sets(store, "embedding")
        .filter(F.array_contains("tags", tag) & F.col("embedding").isNotNull())
        .select(F.lit(tag).alias("tag"), array_to_vector("embedding").alias("_vector"))
        .groupBy("tag").agg(F.count("*").alias("n"), _mean_vector())
    )
