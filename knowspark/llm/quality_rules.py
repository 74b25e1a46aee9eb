"""Quality rules with thresholds that adapt to language and source.

In DataFrame operations only. Four numbers are taken of every whole text. For
each (language, source), each language and all documents a mergeable quantile
sketch of a metric's rate gives its quartiles; a document fails where it lies far
beyond them. The sketches combine before the shuffle, so a source with a third of
all rows sends one sketch per task.

A document is kept unless the base rule fails it (``n_words < 20`` or
``100 * n_repeat_words > 30 * n_words``) or a rate exceeds the group's limit. A
sketch's own limit is ``median + SPREADS * (upper - lower quartile)``, within
``floor`` and ``HIGHEST``; junk of up to a quarter of a group moves neither quartile
far, so it does not raise its own limit. Limits blend by the number of documents:
a group's own counts as its n documents against ``BLEND`` of its language's, and
a language's against ``BLEND`` of all. So no group size switches the rule; one
document more changes a limit by one part in n + ``BLEND``.

NULL texts count as empty (no words, so not kept). NULL languages and sources
form groups of their own. Repeated rows are judged one by one and count each in
the sketches. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from knowspark.llm.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a window that counts as repeated when found twice.
WINDOW = 8
#: Relative rank error of a sketch is one over this.
ACCURACY = 10_000
#: Documents that the wider group counts as in a group's limits.
BLEND = 200
#: Quartiles that a sketch is asked for.
QUANTILES = (0.25, 0.5, 0.75)
SPREADS = 3.0
#: Rates are 1 at most; no limit is above this.
HIGHEST = 0.5
#: rate: (numerator, denominator, least limit)
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 0.05),
    "dup_line_rate": ("n_dup_lines", "n_words", 0.05),
    "repeat_rate": ("n_repeat_words", "n_words", 0.25),
}


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by windows of eight found twice or more, first included:
    sort the windows' hashes with their places, keep equal neighbours, and add
    up what the places cover."""
    windows = F.when(n > WINDOW, F.transform(
        F.sequence(F.lit(1), n - WINDOW + 1),
        lambda i: F.struct(F.xxhash64(F.slice(words, i, WINDOW)).alias("h"), i.alias("i")))) \
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    return F.aggregate(
        F.array(F.array_sort(windows)), F.lit(0).cast("long"),
        lambda total, s: F.aggregate(
            F.array(F.array_sort(F.transform(
                F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"])
                         | (F.get(s, j + 1)["h"] == x["h"])), lambda x: x["i"]))),
            F.lit(0).cast("long"),
            lambda t, p: F.aggregate(
                F.transform(p, lambda x, j: F.least(
                    F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))).cast("long")),
                F.lit(0).cast("long"), lambda a, b: a + b)))


def metrics(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base numbers of each whole text."""
    base = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source",
        F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", "")))
        .cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words"), n).alias("n_repeat_words"))


def _rate(name: str) -> Column:
    above, below, _ = RATES[name]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def _own_limit(name: str) -> Column:
    low, middle, high = (F.col(name)[i] for i in range(3))
    return F.least(F.lit(HIGHEST), F.greatest(
        F.lit(RATES[name][2]), middle + SPREADS * (high - low))).alias(name)


def _blended(name: str, wider: Column) -> Column:
    return ((F.col("n") * F.col(name) + BLEND * wider) / (F.col("n") + BLEND)).alias(name)


def thresholds(measured: DataFrame) -> DataFrame:
    """``lang, source, n`` and the limit of each rate, one row per language and source."""
    quartiles = [F.percentile_approx(_rate(r), list(QUANTILES), ACCURACY).alias(r) for r in RATES]
    sketches = measured.rollup("lang", "source").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *quartiles) \
        .select("level", "lang", "source", "n", *map(_own_limit, RATES))
    sketches = written(sketches, "quality-limits")
    whole = sketches.filter("level = 3").first()  # one row, none without documents
    all_of = {r: F.lit(whole[r] if whole else HIGHEST) for r in RATES}
    language = sketches.filter("level = 1").select(
        F.col("lang").alias("l"), *[_blended(r, all_of[r]).alias(f"wider_{r}") for r in RATES])
    return sketches.filter("level = 0").join(language, F.col("lang").eqNullSafe(F.col("l"))).select(
        "lang", "source", "n", *[_blended(r, F.col(f"wider_{r}")) for r in RATES])


def apply_rules(documents: DataFrame) -> DataFrame:
    """Every document with its numbers and verdict."""
    measured = written(metrics(documents), "quality-metrics")
    limits = thresholds(measured).select(
        F.col("lang").alias("g_lang"), F.col("source").alias("g_source"),
        *[F.col(r).alias(f"{r}_limit") for r in RATES])
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("g_lang"))
                           & F.col("source").eqNullSafe(F.col("g_source")))
    over = [_rate(r) > F.col(f"{r}_limit") for r in RATES]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~(over[0] | over[1] | over[2])).alias("kept"))
