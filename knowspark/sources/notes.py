"""Sources of entries to ingest: text files and JSON batches."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowspark import schema
from knowspark.functions import text

#: Equal lines that one task makes again.
NUMBERED = 4096


def read_text_notes(spark: SparkSession, path: str) -> DataFrame:
    """Each ``.txt`` file becomes one note; its path is its entry id."""
    raw = (
        spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value"))
    )
    content = text.strip("value", text.JS_SPACE)
    return raw.select(
        F.md5("file_path").alias("entry_id"),
        content.alias("content"),
        F.lit("note").alias("content_type"),
        F.lit(None).cast("string").alias("title"),
        F.array().cast("array<string>").alias("tags"),
        F.lit("api").alias("source"),
        F.lit("{}").alias("metadata"),
    ).filter(F.col("content") != "")


def read_entries_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of entries. A line that is no JSON keeps its text in
    ``_corrupt_record`` and is rejected by validation.

    ``metadata`` may be any JSON object; it is kept as JSON text. Entries
    without ``entry_id`` get one from their file, their own fields and a number
    among equal entries of the file, so it does not depend on how files are split.
    """
    corrupt = T.StructField("_corrupt_record", T.StringType())
    struct = T.StructType([*schema.ENTRIES.fields, corrupt])
    raw = spark.read.schema(struct).option("mode", "PERMISSIVE").json(path) \
        .withColumn("_file", F.col("_metadata.file_path"))
    named = raw.filter(F.col("entry_id").isNotNull())
    own = F.md5(F.concat_ws(":", "_file", F.to_json(F.struct(*struct.names))))
    nameless = raw.filter(F.col("entry_id").isNull()).withColumn("_own", own)
    return named.select(*struct.names).unionByName(
        _occurrences(nameless, struct.names).withColumn(
            "entry_id", F.md5(F.concat_ws(":", "_own", F.col("_number").cast("string"))))
        .select(*struct.names))


def _occurrences(lines: DataFrame, columns: list) -> DataFrame:
    """Lines with a number (from 1) among equal ones, by counting: equal lines differ in
    nothing else, so each is counted before the shuffle, and that many are made again,
    ``NUMBERED`` at a time and dealt over tasks."""
    counted = lines.groupBy("_own", *columns).agg(F.count(F.lit(1)).alias("_n"))
    many = counted.withColumn("_from", F.explode(F.expr(f"sequence(1L, _n, {NUMBERED}L)"))) \
        .repartition("_own", "_from")
    return many.withColumn("_number", F.explode(F.expr(
        f"sequence(_from, least(_n, _from + {NUMBERED - 1}L))")))
