"""The four tables derived from the star-schema test tables.

Documents become thoughts, orders tasks, customers contacts and parts home
items; every fourth test vector goes to each table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspark.sources.store import Store

# --- Fixed values: schemas of the given tables ---
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
# --- end of fixed values ---


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int = None) -> DataFrame:
    """One given table, dealt anew over so many ``partitions`` if given: for work
    that is heavy per row over a file of one row group."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")
    return df if partitions is None else df.repartition(partitions)


def _vectors(spark: SparkSession, sf_dir: str, slot: int) -> DataFrame:
    return (
        read_table(spark, sf_dir, "embeddings")
        .filter(F.col("vec_id") % 4 == slot)
        .select(F.expr("vec_id div 4").alias("_key"), "embedding")
    )


def thought_columns(documents: DataFrame) -> DataFrame:
    """Documents as thoughts without vectors; also used on a stream."""
    return documents.selectExpr(
        "doc_id",
        "concat('d', doc_id) AS id",
        "replace(text, '\\n', '\\n\\n') AS content",
        "CASE doc_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'thought' ELSE 'event' END "
        "AS content_type",
        "CASE WHEN doc_id % 4 <> 0 THEN concat('Doc ', doc_id) END AS title",
        "array(concat('topic-', doc_id % 12), lang, source) AS tags",
        "source",
        "timestampadd(MINUTE, doc_id * 37, timestamp_ntz'2024-01-01') AS created_at",
    )


def thoughts(spark: SparkSession, sf_dir: str, partitions: int = None) -> DataFrame:
    docs = thought_columns(read_table(spark, sf_dir, "documents", partitions))
    joined = docs.join(_vectors(spark, sf_dir, 0), F.col("doc_id") == F.col("_key"), "left")
    return joined.select(
        "id", "content", "embedding", "source", "content_type", "title", "tags",
        F.lit("{}").alias("metadata"), F.lit(0).alias("chunk_index"),
        F.lit(None).cast("string").alias("parent_id"), "created_at",
        F.col("created_at").alias("updated_at"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    joined = orders.join(
        _vectors(spark, sf_dir, 1), F.col("o_orderkey") == F.col("_key"), "left")
    return joined.selectExpr(
        "concat('t', o_orderkey) AS id",
        "concat('Order ', o_orderkey) AS title",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS notes",
        "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'cancelled' END "
        "AS status",
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' "
        "WHEN '3' THEN 'medium' ELSE 'low' END AS priority",
        "CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS due_date",
        "CASE o_orderkey % 5 WHEN 0 THEN 7 WHEN 1 THEN 30 END AS recurrence_days",
        "CASE o_orderkey % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'work' WHEN 2 THEN 'personal' "
        "WHEN 3 THEN 'health' WHEN 4 THEN 'finance' ELSE 'home' END AS category",
        "array(concat('topic-', o_orderkey % 12), concat('clerk-', o_custkey % 7)) AS tags",
        "embedding",
        "o_orderdate AS created_at",
        "o_orderdate AS updated_at",
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = (
        read_table(spark, sf_dir, "orders")
        .groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_contact_at"))
    )
    joined = (
        read_table(spark, sf_dir, "customer")
        .join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(_vectors(spark, sf_dir, 2), F.col("c_custkey") == F.col("_key"), "left")
    )
    return joined.selectExpr(
        "concat('c', c_custkey) AS id",
        "c_name AS name",
        "CASE WHEN c_custkey % 5 <> 0 THEN concat('c', c_custkey, '@example.org') END AS email",
        "CAST(NULL AS STRING) AS phone",
        "c_mktsegment AS company",
        "CASE WHEN c_mktsegment <> 'BUILDING' THEN last_contact_at END AS last_contact_at",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('segment ', c_mktsegment) END AS notes",
        "array(concat('topic-', c_custkey % 12), lower(c_mktsegment)) AS tags",
        "embedding",
        "timestampadd(MINUTE, c_custkey, timestamp_ntz'1995-01-01') AS created_at",
        "timestampadd(MINUTE, c_custkey, timestamp_ntz'1995-01-01') AS updated_at",
    )


def home_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey").agg(F.max("l_shipdate").alias("last_done_at"))
    )
    joined = (
        read_table(spark, sf_dir, "part")
        .join(last, F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(_vectors(spark, sf_dir, 3), F.col("p_partkey") == F.col("_key"), "left")
    )
    return joined.selectExpr(
        "concat('h', p_partkey) AS id",
        "p_name AS name",
        "CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS notes",
        "last_done_at",
        "CASE WHEN p_size % 7 <> 0 THEN timestampadd(DAY, p_size, last_done_at) END "
        "AS next_due_at",
        "CASE WHEN p_size % 7 <> 0 THEN p_size END AS interval_days",
        "array(concat('topic-', p_partkey % 12), lower(p_type)) AS tags",
        "embedding",
        "timestampadd(MINUTE, p_partkey, timestamp_ntz'1995-01-01') AS created_at",
        "timestampadd(MINUTE, p_partkey, timestamp_ntz'1995-01-01') AS updated_at",
    )


def load(spark: SparkSession, sf_dir: str) -> Store:
    return Store(
        thoughts=thoughts(spark, sf_dir), tasks=tasks(spark, sf_dir),
        contacts=contacts(spark, sf_dir), home_items=home_items(spark, sf_dir))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes cut into chunk rows: turn 0 is the parent."""
    return chunk_columns(read_table(spark, sf_dir, "conversations"))


def chunk_columns(conversations: DataFrame) -> DataFrame:
    return conversations.selectExpr(
        "concat('v', conv_id, '-', turn) AS id",
        "text AS content",
        "'note' AS content_type",
        "concat('Conversation ', conv_id) AS title",
        "array(role) AS tags",
        "CAST(turn AS INT) AS chunk_index",
        "CASE WHEN turn > 0 THEN concat('v', conv_id, '-0') END AS parent_id",
        "timestampadd(MINUTE, conv_id * 10 + turn, timestamp_ntz'2024-01-01') AS created_at",
    )


def long_notes(spark: SparkSession, sf_dir: str, partitions: int = None) -> DataFrame:
    """Documents with a blank line between any two words: only the sliding
    window can cut them."""
    return read_table(spark, sf_dir, "documents", partitions).select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        F.regexp_replace("text", "[ \n]+", "\n\n").alias("content"),
        F.lit("note").alias("content_type"))


def entries(spark: SparkSession, sf_dir: str, partitions: int = None) -> DataFrame:
    """Documents as requests to ingest; some carry a type no entry may have."""
    return entry_columns(read_table(spark, sf_dir, "documents", partitions))


def entry_columns(documents: DataFrame) -> DataFrame:
    return thought_columns(documents).select(
        F.col("id").alias("entry_id"), "content",
        F.when(F.col("doc_id") % 9 == 8, "task").otherwise(F.col("content_type"))
        .alias("content_type"),
        "title", "tags", "source",
        F.to_json(F.struct("doc_id")).alias("metadata"), "created_at")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged interactions with contacts."""
    return interaction_columns(read_table(spark, sf_dir, "events"))


def interaction_columns(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "concat('c', user_id) AS contact_id", "ts",
        "concat(event_type, ' ', CAST(value AS STRING)) AS note")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list:
    """One stored vector, as the search operators take it."""
    row = read_table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id) \
        .select("embedding").limit(1).collect()
    return list(row[0][0])
