"""Text rules as Column expressions: whitespace, words, paragraphs, tags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the service's Python code sees it, built from Python's own rule.
PY_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
PY_SPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"
# Whitespace as the browser pages see it: adds the byte order mark, lacks the
# information separators and NEL.
JS_SPACE = "".join(c for c in PY_SPACE if c not in "\x1c\x1d\x1e\x1f\x85") + "﻿"
JS_SPACE_RUN = r"[\s\p{Z}﻿]+"

# --- Fixed values: chunk and tag rules ---
MIN_PARAGRAPH = 50
WINDOW_WORDS = 500
WINDOW_OVERLAP = 50
NOT_IN_TAG = "[^a-z0-9_-]"
MAX_TAG = 40
MAX_TAGS_FORM = 20
MAX_TAGS_REFINE = 5
# --- end of fixed values ---


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(column, spaces: str = PY_SPACE) -> Column:
    return F.btrim(_c(column), F.lit(spaces))


def words(column, run: str = PY_SPACE_RUN) -> Column:
    return F.filter(F.split(_c(column), run), lambda w: w != "")


def paragraphs(column, spaces: str = PY_SPACE, minimum: int = MIN_PARAGRAPH) -> Column:
    """Stripped blank-line-separated parts of at least ``minimum`` characters."""
    parts = F.transform(F.split(_c(column), "\n\n"), lambda p: strip(p, spaces))
    return F.filter(parts, lambda p: F.length(p) >= minimum)


def word_windows(word_array, size: int = WINDOW_WORDS, overlap: int = WINDOW_OVERLAP) -> Column:
    """Overlapping windows over a word array; the last one reaches its end."""
    array = _c(word_array)
    step = size - overlap
    n = F.size(array)
    last = F.greatest(F.ceil((n - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(array, i * step + 1, F.lit(size)), " "),
    )


def normalize_tag(column) -> Column:
    """Lower case, only ``a-z 0-9 _ -``, at most 40 characters."""
    return F.substring(F.regexp_replace(F.lower(_c(column)), NOT_IN_TAG, ""), 1, MAX_TAG)


def clean_tags(tags, cap: int = MAX_TAGS_FORM) -> Column:
    """Normalised, non-blank, distinct in order, the first ``cap``."""
    norm = F.transform(_c(tags), normalize_tag)
    return F.slice(F.array_distinct(F.filter(norm, lambda t: t != "")), 1, cap)


def detect_type(column) -> Column:
    """Content type the capture page proposes."""
    long_parts = F.size(paragraphs(column, JS_SPACE))
    return F.when(
        (long_parts >= 2) | (F.size(words(column, JS_SPACE_RUN)) > WINDOW_WORDS), "note"
    ).otherwise("thought")


def embed_text(*columns) -> Column:
    """The non-empty parts joined by a newline."""
    parts = F.array(*[_c(c) for c in columns])
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n")


def item_content(head, notes) -> Column:
    """Displayed content: the notes follow the heading whenever they are not NULL."""
    return F.when(
        _c(notes).isNotNull(), F.concat(_c(head), F.lit("\n"), _c(notes))
    ).otherwise(_c(head))


def stable_uuid(*columns) -> Column:
    """A UUID-shaped id derived from its inputs, the same on every retry."""
    h = F.md5(F.concat_ws(":", *[_c(c).cast("string") for c in columns]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, start, n) for start, n in cuts])
