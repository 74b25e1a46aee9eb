"""The unified view of thoughts, tasks, contacts and home items."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowspark import schema
from knowspark.functions.text import item_content
from knowspark.operators.ranks import in_order
from knowspark.operators.reduced import semi_join
from knowspark.sources.store import Store

COLUMNS = ("id", "content", "title", "tags", "content_type", "created_at")


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in order; a per-task top-n plus one small merge."""
    return df.orderBy(*order).limit(n)


def parents(thoughts: DataFrame) -> DataFrame:
    return thoughts.filter(F.col("parent_id").isNull())


def unified_items(store: Store, embedding: bool = False) -> DataFrame:
    """UNION ALL of the four tables in one shape; of thoughts only parents.

    A later filter on ``content_type`` removes whole branches, and unused
    columns are never scanned.
    """
    extra = ["embedding"] if embedding else []

    def headed(df, head, kind):
        return df.select(
            "id", item_content(head, "notes").alias("content"), F.col(head).alias("title"),
            "tags", F.lit(kind).alias("content_type"), "created_at", *extra)

    branches = [
        parents(store.thoughts).select(*COLUMNS, *extra),
        headed(store.tasks, "title", "task"),
        headed(store.contacts, "name", "contact"),
        headed(store.home_items, "name", "home_item"),
    ]
    return reduce(DataFrame.unionByName, branches)


def items_by_tag(store: Store, tag: str, rank: bool = False) -> DataFrame:
    """Every item that carries the tag, newest first."""
    return in_order(unified_items(store).filter(F.array_contains("tags", tag)),
                    F.desc("created_at"), "id", rank=rank)


def items_by_type(items: DataFrame) -> DataFrame:
    """Count per item type, in the order the tag page shows its sections."""
    position = F.lit(None).cast("int")
    for i, kind in reversed(list(enumerate(schema.ITEM_TYPE_ORDER))):
        position = F.when(F.col("content_type") == kind, i).otherwise(position)
    return (
        items.groupBy("content_type").agg(F.count("*").alias("n"))
        .withColumn("position", position).filter("position IS NOT NULL").orderBy("position")
    )


def get_rows(table: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of a few known ids. The list reaches the scan, where the Bloom
    filters that the store writes skip files without them."""
    return table.filter(F.col(key).isin(list(ids)))


def lookup(table: DataFrame, ids: DataFrame, key: str = "id", reduce: bool = False) -> DataFrame:
    """Rows of a table whose id occurs in the first column of ``ids``.

    Repeats of an id are combined before the shuffle; a sort-merge join reuses
    that shuffle, and AQE broadcasts a small side. ``reduce`` is for ids that are too
    many to broadcast, but few against the table: a bitmap of them cuts the table
    down before it is shuffled.
    """
    asked = ids.select(F.col(ids.columns[0]).alias(key))
    if reduce:
        return semi_join(table, asked, key)
    return table.join(asked.distinct(), key, "left_semi")


def write_tag_index(store: Store, path: str) -> None:
    """One row per tag and item, range-partitioned and sorted by tag.

    Reading one tag then opens only the row groups that hold it. The id is part
    of the range key, so a tag that many items share spreads over many files.
    """
    (
        unified_items(store).withColumn("tag", F.explode(F.array_distinct("tags")))
        .repartitionByRange("tag", "id").sortWithinPartitions("tag", F.desc("created_at"), "id")
        .write.mode("errorifexists").parquet(path)
    )


def items_by_tag_indexed(spark, path: str, tag: str) -> DataFrame:
    """:func:`items_by_tag` served from the index."""
    return (
        spark.read.parquet(path).filter(F.col("tag") == tag).drop("tag")
        .orderBy(F.desc("created_at"), "id")
    )
