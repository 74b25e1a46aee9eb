"""Recent thoughts, date ranges, statistics and the activity review."""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowspark.functions.times import instant, instant_for, micros
from knowspark.operators.items import COLUMNS, parents, top
from knowspark.operators.ranks import in_order
from knowspark.sources.store import Store


def _parents(store: Store, content_type: str = None) -> DataFrame:
    df = parents(store.thoughts)
    return df if content_type is None else df.filter(F.col("content_type") == content_type)


def _newest(df: DataFrame, limit: int) -> DataFrame:
    return top(df.select(*COLUMNS, "source"), limit, F.desc("created_at"), "id")


def recent(store: Store, limit: int = 10, content_type: str = None) -> DataFrame:
    return _newest(_parents(store, content_type), limit)


def by_any_tag(store: Store, tags: list, limit: int = 20) -> DataFrame:
    """Newest thoughts that share at least one tag with the list."""
    wanted = F.array(*[F.lit(t) for t in tags]).cast("array<string>")
    return _newest(_parents(store).filter(F.arrays_overlap("tags", wanted)), limit)


def by_date_range(
        store: Store, start, end, content_type: str = None, limit: int = 100) -> DataFrame:
    """Newest thoughts created in the range, both ends included."""
    df = _parents(store, content_type)
    return _newest(df.filter(F.col("created_at").between(
        instant_for(df, "created_at", start), instant_for(df, "created_at", end))), limit)


def stats_by_type(store: Store) -> DataFrame:
    """Rows per content type; chunk rows count too."""
    return store.thoughts.groupBy("content_type").agg(F.count("*").alias("n"))


def stats_total(store: Store) -> DataFrame:
    return store.thoughts.agg(
        F.count("*").alias("total"), F.max("created_at").alias("most_recent"))


def stats_range(store: Store) -> DataFrame:
    return store.thoughts.agg(
        F.count("*").alias("total"), F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"))


def review_rows(store: Store, as_of, days: int = 7) -> DataFrame:
    df = _parents(store)
    since = instant_for(df, "created_at", instant(as_of) - dt.timedelta(days=days))
    return df.filter(F.col("created_at") >= since)


def review_entries(store: Store, as_of, days: int = 7, rank: bool = False) -> DataFrame:
    return in_order(review_rows(store, as_of, days).select(*COLUMNS),
                    F.desc("created_at"), "id", rank=rank)


def review_total(store: Store, as_of, days: int = 7) -> DataFrame:
    return review_rows(store, as_of, days).agg(F.count("*").alias("total"))


def review_by_type(store: Store, as_of, days: int = 7) -> DataFrame:
    return review_rows(store, as_of, days).groupBy("content_type").agg(F.count("*").alias("n"))


def review_top_tags(store: Store, as_of, days: int = 7, k: int = 10) -> DataFrame:
    """``rank, tag, count`` of the most frequent tags; equal counts keep the order in
    which the tags first appear when the entries are read newest first.

    Counts and newest times are numbers, so all tags are aggregated by hash. The
    k best by these come first; only where tags tie in both does the entry's id
    and the place in it decide, and only those entries are looked at again.
    """
    seen = review_rows(store, as_of, days).select(
        (-micros("created_at")).alias("age"), "id", F.posexplode("tags").alias("pos", "tag"))
    counted = seen.groupBy("tag").agg(F.count("*").alias("count"), F.min("age").alias("age"))
    best = top(counted, k + 1, F.desc("count"), "age").collect()  # k + 1 rows at most
    ties = len(best) > k and best[k][1:] == best[k - 1][1:]
    best = best[:k]
    if ties:
        last = best[-1]
        chosen = counted.filter((F.col("count") > last[1]) | (
            (F.col("count") == last[1]) & (F.col("age") <= last.age)))
    else:
        chosen = seen.sparkSession.createDataFrame(best, "tag string, count long, age long")
    first = Window.partitionBy("tag").orderBy("id", "pos")
    found = seen.filter(F.col("age").isin([r.age for r in best]) if not ties else F.lit(True)) \
        .join(chosen, ["tag", "age"]).withColumn("n", F.row_number().over(first)).filter("n = 1")
    order = F.desc("count"), "age", "id", "pos"
    return top(found, k, *order).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order))).select("rank", "tag", "count")
