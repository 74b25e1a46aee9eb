"""Ingest: validate, default, chunk, embed, refine."""

from hashlib import md5
from itertools import chain
from typing import Callable, Iterator, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knowspark import schema
from knowspark.functions import text

# Validation -----------------------------------------------------------------


def _length_rule(column: str, maximum: int, required: bool) -> list:
    c = F.col(column)
    size = F.length(c)
    rules = [(size < 1, f"{column} is empty"), (size > maximum, f"{column} is too long")]
    return [(c.isNull(), f"{column} is missing")] + rules if required else rules


def _set_rule(column: str, allowed: tuple) -> tuple:
    return (~F.col(column).isin(*allowed), f"{column} is not allowed")


def _rules(kind: str, required: bool) -> list:
    if kind == "entries":
        return _length_rule("content", schema.MAX_CONTENT, required) + [
            _set_rule("content_type", schema.CONTENT_TYPES)]
    if kind == "tasks":
        return _length_rule("title", schema.MAX_TASK_TITLE, required) + [
            _set_rule("status", schema.TASK_STATUSES),
            _set_rule("priority", schema.TASK_PRIORITIES),
            _set_rule("category", schema.TASK_CATEGORIES)]
    if kind == "contacts":
        return _length_rule("name", schema.MAX_CONTACT_NAME, required)
    if kind == "home_items":
        return _length_rule("name", schema.MAX_HOME_NAME, required)
    if kind == "interactions":
        return _length_rule("note", schema.MAX_INTERACTION_NOTE, True)
    raise ValueError(f"unknown kind {kind!r}")


def check(df: DataFrame, kind: str, update: bool = False) -> DataFrame:
    """Adds ``reject_reasons``, empty for a valid row.

    A NULL in a closed-set column is valid, the default fills it. With ``update``
    NULL means "keep", also where a new row must have a value. An absent column
    counts as NULL.
    """
    have = set(df.columns)
    required, closed = {
        "entries": ("content", ("content_type",)),
        "tasks": ("title", ("status", "priority", "category")),
        "contacts": ("name", ()), "home_items": ("name", ()), "interactions": ("note", ()),
    }[kind]
    if required not in have and not update:
        raise ValueError(f"{kind} need a column {required!r}")
    absent = [c for c in (required, *closed) if c not in have]
    full = df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df
    reasons = [F.when(bad, F.lit(why)) for bad, why in _rules(kind, not update)]
    if "_corrupt_record" in have:
        reasons.append(F.when(F.col("_corrupt_record").isNotNull(), "not valid JSON"))
    out = full.withColumn("reject_reasons", F.array_compact(F.array(*reasons)))
    return out.select(*df.columns, "reject_reasons")


def split_valid(checked: DataFrame) -> tuple:
    """The valid rows and the rejected ones."""
    ok = F.size("reject_reasons") == 0
    return checked.filter(ok).drop("reject_reasons"), checked.filter(~ok)


def validate(df: DataFrame, kind: str, update: bool = False) -> tuple:
    return split_valid(check(df, kind, update))


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """NULL or absent columns with a default get it."""
    changes = {}
    for column, value in schema.DEFAULTS[table].items():
        dtype = schema.TABLES[table][column].dataType
        default = (F.array() if isinstance(value, list) else F.lit(value)).cast(dtype)
        changes[column] = F.coalesce(F.col(column), default) if column in df.columns else default
    return df.withColumns(changes)


# Chunking -------------------------------------------------------------------


def chunk_arrays(df: DataFrame, content: str = "content",
                 content_type: str = "content_type") -> DataFrame:
    """Adds ``chunks``: the pieces a content is stored in.

    A note is cut at blank lines, keeping paragraphs of at least 50 characters.
    Without any, a note of more than 500 words is cut into word windows. All
    else is one piece. Narrow, and no Python.
    """
    note = F.col(content_type).eqNullSafe("note")
    pieces = F.size("_paragraphs") > 0
    staged = (
        df.withColumn("_paragraphs", F.when(note, text.paragraphs(content)))
        .withColumn("_words", F.when(note & ~pieces, text.words(content)))
        .withColumn("chunks", F.when(~note, F.array(F.col(content)))
                    .when(pieces, F.col("_paragraphs"))
                    .when(F.size("_words") > text.WINDOW_WORDS, text.word_windows("_words"))
                    .otherwise(F.array(text.strip(content))))
    )
    return staged.drop("_paragraphs", "_words")


def _exploded(arrays: DataFrame, df: DataFrame) -> DataFrame:
    """``chunks`` as rows. The array is never empty; the outer form keeps Catalyst
    from testing its size below, which would cut every text twice."""
    rest = [c for c in df.columns if c not in ("chunk_index", "total_chunks", "text")]
    return arrays.select(
        *rest, F.size("chunks").alias("total_chunks"),
        F.posexplode_outer("chunks").alias("chunk_index", "text"))


def chunk(df: DataFrame, content: str = "content",
          content_type: str = "content_type") -> DataFrame:
    """One row per piece: ``chunk_index``, ``total_chunks``, ``text``."""
    return _exploded(chunk_arrays(df, content, content_type), df)


def chunk_sliding(df: DataFrame, content: str = "content", size: int = text.WINDOW_WORDS,
                  overlap: int = text.WINDOW_OVERLAP) -> DataFrame:
    """One row per word window, whatever the length; wordless text stays whole."""
    staged = df.withColumn("_words", text.words(content))
    staged = staged.withColumn(
        "chunks", F.when(F.size("_words") > 0, text.word_windows("_words", size, overlap))
        .otherwise(F.array(F.col(content))))
    return _exploded(staged, df)


# Embedding ------------------------------------------------------------------


#: Texts a model gets at once, whatever the size of an Arrow batch.
MODEL_BATCH = 512


class Embedder(Protocol):
    """A text embedding model; built once per Python worker."""

    dimensions: int

    def embed_batch(self, texts: list) -> list: ...


class HashEmbedder:
    """Deterministic embedding without a model: lower-cased words are counted in
    md5 buckets and the counts scaled to length one."""

    def __init__(self, dimensions: int = schema.EMBEDDING_DIMS):
        self.dimensions = dimensions

    def embed_batch(self, texts: list) -> list:
        """Each distinct word of the batch is hashed once, all texts are counted
        together."""
        words = [value.lower().split() for value in texts]
        coded = pa.array(list(chain.from_iterable(words)), pa.large_string()).dictionary_encode()
        buckets = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % self.dimensions
                            for w in coded.dictionary.to_pylist()], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        cells = row * self.dimensions + buckets[coded.indices.to_numpy()]
        counts = np.bincount(cells, minlength=len(texts) * self.dimensions).astype(float)
        counts = counts.reshape(len(texts), self.dimensions)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return list((counts / np.where(length > 0, length, 1)).astype(np.float32))


def embedding_of(column, make_embedder: Callable[[], Embedder] = HashEmbedder) -> Column:
    """Embedding of a text column; NULL text gives NULL.

    An iterator Arrow UDF: the model loads once per task, texts go to it in
    batches, and only the text column leaves the JVM. Marked as not deterministic, or
    Catalyst would run the model a second time below a filter on the vector.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make_embedder()
        for texts in batches:
            present = texts.drop_null().to_pylist()
            vectors = chain.from_iterable(
                model.embed_batch(present[i:i + MODEL_BATCH])
                for i in range(0, len(present), MODEL_BATCH))
            rows = [next(vectors) if known else None for known in texts.is_valid().to_pylist()]
            if any(v is not None and len(v) != model.dimensions for v in rows):
                raise ValueError(f"the model must return {model.dimensions} dimensions")
            yield pa.array(rows, pa.list_(pa.float32()))

    return embed_all.asNondeterministic()(F.col(column) if isinstance(column, str) else column)


def embed(df: DataFrame, text_column: str,
          make_embedder: Callable[[], Embedder] = HashEmbedder,
          out: str = "embedding") -> DataFrame:
    return df.withColumn(out, embedding_of(text_column, make_embedder))


def embed_rows(df: DataFrame, table: str,
               make_embedder: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """Embeds new rows of a table from the columns whose text it searches."""
    return df.withColumn("embedding", embedding_of(
        text.embed_text(*schema.EMBEDDED_TEXT[table]), make_embedder))


# Entries to thoughts --------------------------------------------------------


def ingest(entries: DataFrame, as_of=None,
           make_embedder: Callable[[], Embedder] = None) -> DataFrame:
    """Chunk rows of valid entries, ready to append to ``thoughts``.

    Chunk 0 is the parent; title, tags, source and metadata are copied to every
    chunk. Ids derive from the entry id and the chunk index, so a retried task
    writes the same ids. All steps are narrow.
    """
    filled = apply_defaults(entries, "thoughts").drop("chunk_index")
    if "created_at" not in filled.columns:
        created = F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")
        filled = filled.withColumn("created_at", created)
    rows = chunk(filled).select(
        text.stable_uuid("entry_id", "chunk_index").alias("id"),
        F.col("text").alias("content"),
        "source", "content_type", "title", "tags", "metadata", "chunk_index",
        F.when(F.col("chunk_index") > 0, text.stable_uuid("entry_id", F.lit(0)))
        .alias("parent_id"),
        "created_at", F.col("created_at").alias("updated_at"), "entry_id")
    return rows if make_embedder is None else embed(rows, "content", make_embedder)


def ingest_summary(entries: DataFrame) -> DataFrame:
    """Chunks created per entry, without writing them out: no shuffle."""
    return chunk_arrays(apply_defaults(entries, "thoughts")).select(
        "entry_id", "content_type", F.size("chunks").alias("chunks_created"))


def ingest_totals(entries: DataFrame) -> DataFrame:
    return ingest_summary(entries).agg(
        F.count("*").alias("total_entries"), F.sum("chunks_created").alias("total_chunks"))


# Refinement -----------------------------------------------------------------


class Refiner(Protocol):
    """Cleans up one raw text: returns ``(content, title, tags)`` or raises."""

    def refine(self, raw: str, content_type: str) -> tuple: ...


class IdentityRefiner:
    """Keeps the text and suggests nothing."""

    def refine(self, raw: str, content_type: str) -> tuple:
        return raw, None, []


REFINED = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


#: Bytes of text that are sent through a backend before their answers are passed on.
REFINED_BYTES = 2 << 20


def text_runs(texts: pa.Array, least: int = 1) -> Iterator[slice]:
    """An Arrow batch of texts in runs of about ``REFINED_BYTES``: what a task holds does
    not grow with the batch. All but the last run have a multiple of ``least`` rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    start = held = 0
    for end in range(least, len(texts), least):
        held += int(sizes[end - least:end].sum())
        if held >= REFINED_BYTES:
            yield slice(start, end)
            start, held = end, 0
    if start < len(texts):
        yield slice(start, len(texts))


def answers_of(rows: list) -> pa.Array:
    """Answers as an Arrow column of ``REFINED``."""
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    return pa.StructArray.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], REFINED.names)


def refine(df: DataFrame, make_refiner: Callable[[], Refiner] = IdentityRefiner) -> DataFrame:
    """Sends ``content`` through a backend and post-processes the answer.

    A failure of the backend becomes ``refine_error`` of that row; the job goes on.
    """

    @F.arrow_udf(REFINED)
    def call(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        backend = make_refiner()
        for texts, types in batches:
            for run in text_runs(texts):
                rows = []
                for raw, kind in zip(texts[run].to_pylist(), types[run].to_pylist()):
                    try:
                        content, title, tags = backend.refine(raw, kind or "thought")
                        rows.append((content, title, list(tags or []), None))
                    except Exception as error:  # any backend failure concerns its row only
                        rows.append((None, None, None, f"the refiner failed: {error}"))
                yield answers_of(rows)

    answered = df.withColumn("_r", call("content", "content_type"))
    return refine_postprocess(
        answered.withColumns({
            "content": F.col("_r.content"), "title": F.col("_r.title"),
            "tags": F.col("_r.tags"), "refine_error": F.col("_r.error")}).drop("_r"))


def refine_postprocess(df: DataFrame) -> DataFrame:
    """Strips content and title, normalises tags and keeps the first five.

    Empty content is an error in ``refine_error``; a blank title becomes NULL.
    """
    earlier = F.col("refine_error") if "refine_error" in df.columns else F.lit(None)
    content = text.strip("content")
    return df.withColumns({
        "content": content,
        "title": F.nullif(text.strip("title"), F.lit("")),
        "tags": F.coalesce(
            text.clean_tags("tags", text.MAX_TAGS_REFINE), F.array().cast("array<string>")),
        "refine_error": F.coalesce(
            earlier.cast("string"),
            F.when(content.isNull() | (content == ""),
                   F.lit("the refiner gave no content"))),
    })
