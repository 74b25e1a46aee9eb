"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from knowspark.llm.scratch import written


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; NULL for a NULL doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from. A NULL doc_id has no label: false."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents, the ones
    whose id and text hash lowest; written, since it is read several times.

    Rows without id or label are left out; rows equal in id and text count once. The
    bound holds for documents and not only for labels: an id that very many texts
    share gives no more of them than there is room.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
                & (remainder(F.col("doc_id")) != 0))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows))
    # At most ``rows`` pairs, then triples, of numbers: bounded whatever the corpus.
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = docs.join(F.broadcast(chosen), "doc_id") \
        .select("doc_id", "label", F.xxhash64("text").alias("print")).distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "print", "label").limit(rows)
    return written(
        docs.withColumn("print", F.xxhash64("text")).join(F.broadcast(found), ["doc_id", "print"])
        .dropDuplicates(["doc_id", "print", "label"]).select("doc_id", "text", "label"), "labelled")
