"""The four tables as Parquet folders on shared storage.

``<root>/<table>/`` holds one table. A snapshot is a root that the caller names:
write all tables to a fresh root, then hand that name on. Appends add files to a
table. Readers fail on a table that is not there.
"""

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspark import schema

#: Sort column of each table: newest-first, due and stale filters then skip row
#: groups through the Parquet minimum and maximum.
SORT_COLUMN = {
    "thoughts": "created_at",
    "tasks": "due_date",
    "contacts": "last_contact_at",
    "home_items": "next_due_at",
}


@dataclass(frozen=True)
class Store:
    thoughts: DataFrame
    tasks: DataFrame
    contacts: DataFrame
    home_items: DataFrame

    def table(self, name: str) -> DataFrame:
        if name not in schema.TABLES:
            raise ValueError(f"unknown table {name!r}")
        return getattr(self, name)

    @staticmethod
    def table_names() -> tuple:
        return tuple(f.name for f in fields(Store))


def read_store(spark: SparkSession, root: str, missing: tuple = ()) -> Store:
    """Typed scans of all four tables; those named in ``missing`` are empty."""
    unknown = set(missing) - set(schema.TABLES)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    return Store(**{
        name: spark.createDataFrame([], struct) if name in missing
        else spark.read.schema(struct).parquet(f"{root}/{name}")
        for name, struct in schema.TABLES.items()})


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and in type; missing ones become NULL."""
    have = set(df.columns)
    unknown = have - set(schema.TABLES[table].names)
    if unknown:
        raise ValueError(f"columns {sorted(unknown)} are not part of {table}")
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.TABLES[table].fields])


def write_store(df: DataFrame, root: str, table: str, append: bool = False) -> None:
    """Write a table of a new snapshot, or add rows to a table that is there.

    Rows are sorted inside each output file only, which needs no shuffle.
    """
    conform(df, table).sortWithinPartitions(SORT_COLUMN[table]) \
        .write.mode("append" if append else "errorifexists") \
        .option("parquet.bloom.filter.enabled#id", "true").parquet(f"{root}/{table}")


def latest_rows(versions: DataFrame, version: str = "version", key: str = "id") -> DataFrame:
    """The newest version of each row of an append-only table.

    Versions are unique per row. Only the version is aggregated, by hash and
    before the shuffle; the rows are fetched by (key, version), so a row with very
    many versions is no hot spot and wide rows are never aggregation buffers.
    """
    newest = versions.groupBy(F.col(key).alias("_key")).agg(F.max(version).alias("_version"))
    return versions.join(newest, (F.col(key) == F.col("_key")) & (F.col(version) == F.col("_version"))) \
        .drop("_key", "_version")


def merge_changes(base: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """The table when changed rows, one per key, are kept beside it: the changed
    rows, and all others from ``base``.

    ``changed`` is best a written table: it is read twice, once for its keys.
    ``base`` is scanned and, while the keys are few enough to broadcast, never
    shuffled. Several generations of changes go through :func:`latest_rows` first.
    """
    return base.join(changed.select(key), key, "left_anti").unionByName(changed)
