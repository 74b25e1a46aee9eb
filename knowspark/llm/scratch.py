"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from knowspark.session import new_work_path


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but column-wise and compressed. A
    lost executor costs nothing that was written.
    """
    spark = df.sparkSession
    path = new_work_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no table needs any more.

    Spark removes them once the driver has collected the plans they belong to;
    after a large intermediate table is written, that should not wait. Python's
    handles are given back in the background, hence the second round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """Names like these that no column has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
