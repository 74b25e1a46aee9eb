"""Notes put together from chunks, and interactions kept in note text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowspark.functions import text

#: Chunks of one note joined in one place at first; a note of any length is
#: spread over as many tasks as it has such parts.
PART_CHUNKS = 256


def _joined(order: list, value: str, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return F.array_join(F.transform(rows, lambda r: r["_v"]), separator)


def ordered_concat(df: DataFrame, key: str, part: Column, order: list, value: str,
                   separator: str, **aggregates) -> DataFrame:
    """Per key the values joined in order, in two steps.

    ``part`` must not decrease along ``order``, and counts rows: parts are bounded.
    Rows are first joined per key and part, so the rows of a hot key are collected by
    many tasks; the second step handles one text per part. The result is one text per key by meaning, a note
    or a notes field; lines without such a bound belong in rows, as chunk rows
    and interaction rows are.

    ``aggregates`` are ``name=(function, column)`` with functions that may be
    applied in two steps, such as sum, min and max.
    """
    first = df.withColumn("_part", part).groupBy(key, "_part").agg(
        _joined(order, value, separator).alias("_text"),
        *[f(c).alias(name) for name, (f, c) in aggregates.items()])
    return first.groupBy(key).agg(
        _joined(["_part"], "_text", separator).alias(value),
        *[f(name).alias(name) for name, (f, _) in aggregates.items()])


def reassemble(thoughts: DataFrame) -> DataFrame:
    """Every note with its chunks joined by blank lines, attributes of chunk 0."""
    rows = thoughts.select(
        F.coalesce("parent_id", "id").alias("_root"), "id", "content", "title", "tags",
        "content_type", "created_at", "chunk_index")
    return _assemble(rows)


def thoughts_full(thoughts: DataFrame, ids: DataFrame) -> DataFrame:
    """The asked-for thoughts in full: each with the chunks that point to it.

    Asking for a chunk gives that chunk alone.
    """
    asked = ids.select(F.col(ids.columns[0]).alias("_root")).distinct()
    own = thoughts.join(asked, thoughts["id"] == asked["_root"])
    chunks = thoughts.join(asked, thoughts["parent_id"] == asked["_root"])
    return _assemble(own.unionByName(chunks))


def _assemble(rows: DataFrame) -> DataFrame:
    attributes = F.struct("id", "title", "tags", "content_type", "created_at")
    place = F.struct("chunk_index", "id")
    ranked = rows.withColumns({
        "_first": F.struct(place.alias("place"), attributes.alias("a")), "_one": F.lit(1)})
    joined = ordered_concat(
        ranked, "_root", F.floor(F.col("chunk_index") / F.lit(PART_CHUNKS)),
        ["chunk_index", "id"], "content", "\n\n",
        _first=(_first_place, "_first"), total_chunks=(F.sum, "_one"))
    return joined.select(
        "_first.a.id", "content", "_first.a.title", "_first.a.tags", "_first.a.content_type",
        "_first.a.created_at", "total_chunks")


def _first_place(column: str) -> Column:
    return F.min_by(F.col(column), F.col(f"{column}.place"))


# Interactions in notes ------------------------------------------------------

# --- Fixed value: how a logged interaction starts ---
INTERACTION = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})? UTC): "
# --- end of fixed value ---


def _note_parts(notes) -> Column:
    parts = F.transform(F.split(notes, "\n\n+"), lambda p: text.strip(p, text.JS_SPACE))
    return F.filter(parts, lambda p: p != "")


def parse_notes(contacts: DataFrame) -> DataFrame:
    """Adds ``profile`` and ``interactions``, newest first, equal stamps in text order.

    Parts are blank-line separated, so a logged note that has a blank line loses
    its later paragraphs to the profile.
    """
    dated = contacts.withColumn("_parts", F.transform(
        _note_parts(F.col("notes")), lambda p, i: F.struct(
            F.regexp_extract(p, INTERACTION, 1).alias("date"), (-i).alias("place"),
            p.alias("part"))))
    logged = F.sort_array(F.filter("_parts", lambda r: r["date"] != ""), asc=False)
    newest = F.transform(logged, lambda r: F.struct(
        r["date"].alias("date"),
        text.strip(F.substr(r["part"], F.length(r["date"]) + 3), text.JS_SPACE)
        .alias("content")))
    other = F.transform(F.filter("_parts", lambda r: r["date"] == ""), lambda r: r["part"])
    empty = F.array().cast("array<struct<date:string,content:string>>")
    return dated.withColumns({
        "profile": F.coalesce(F.array_join(other, "\n\n"), F.lit("")),
        "interactions": F.coalesce(newest, empty)}).drop("_parts")


def interactions_of(contacts: DataFrame) -> DataFrame:
    """The logged interactions as rows ``(contact_id, place, date, content)``."""
    return parse_notes(contacts).select(
        F.col("id").alias("contact_id"), F.posexplode_outer("interactions").alias("place", "_i")
    ).filter(F.col("place").isNotNull()).select("contact_id", "place", "_i.date", "_i.content")
