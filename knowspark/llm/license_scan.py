"""Licence scan by a positional index of rare words, in DataFrame operations only.

1. Inverse document frequency: how many texts of the corpus hold each word of the
   licence templates; one row per template word is counted and comes to the driver.
2. The index: of each template its ``RARE`` rarest words, and the places where they
   stand in it. Of each file the places of those words are looked up.
3. A place p in the file and a place q in the template give an origin p - q. Postings
   are intersected by origin: one on which at least ``AGREE`` different rare words
   agree is a candidate.
4. A template gives its label if each of its mandatory key phrases stands, word for
   word, at its place from some candidate origin. The score is the largest share of
   a template's words that stand at their places from a candidate origin.

Base phrases are templates of their own, mandatory as a whole, whose one rarest word
is looked up: a phrase cannot stand without it, so every place is found.

A file's work is one pass over its words and little for each rare word it holds;
nothing is shuffled but the counts. All of this is array functions over one row.

Result per document: words, places of base phrases with the first and the last,
base labels, all labels, score. NULL and empty texts have no words, no labels and
score 0. Repeated rows are judged each for itself, texts of any length as a whole.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rarest words of a template that are looked up, and how many must agree.
RARE, AGREE = 4, 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# --- Fixed values: phrases of well-known licences, and their labels ---
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Label, words of the template, its mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0",
     ("apache org licenses license 2",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files",
     ("permission is hereby granted free of charge", "associated documentation files")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2",
     ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3",
     ("gnu general public license version 3",)),
    ("lgpl", "under the terms of the gnu lesser general public license",
     ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license",
     ("gnu affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license v 2",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)
# --- end of fixed values ---


def vocabulary() -> list[str]:
    return sorted({w for _, text, *_ in (*BASE, *TEMPLATES) for w in text.split()})


def places(phrase: str, text: str) -> list[int]:
    """Where a phrase's words begin in a template."""
    words, part = text.split(), phrase.split()
    return [i for i in range(len(words)) if words[i:i + len(part)] == part]


def _words(text) -> Column:
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")),
                        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def document_counts(documents: DataFrame) -> dict[str, int]:
    """Texts that hold each template word, counted over all documents."""
    known = F.array(*map(F.lit, vocabulary()))
    held = documents.select(F.explode(F.array_intersect(_words("text"), known)).alias("word"))
    return {r.word: r.n for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def rarest(text: str, counts: dict[str, int], most: int) -> list[str]:
    """The words of a template with the highest inverse document frequency."""
    return sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))[:most]


# Array expressions over ``words`` and ``at`` (places of rare words), as SQL.


def _origins(word: str, text: str) -> str:
    """Where the template would begin, by the places of one of its words."""
    own = ", ".join(f"p - {i}" for i, w in enumerate(text.split()) if w == word)
    return (f"array_distinct(flatten(transform(filter(at, p -> get(words, p) = '{word}'), "
            f"p -> array({own}))))")


def _stands(phrase: str, start: str) -> str:
    """Whether the words of a phrase stand one after another from a place on."""
    return "(" + " AND ".join(f"coalesce(get(words, {start} + {i}) = '{w}', false)"
                              for i, w in enumerate(phrase.split())) + ")"


def _votes(text: str, rare: list[str]) -> str:
    return f"array_sort(concat({', '.join(_origins(w, text) for w in rare)}))"


def _agreed(votes: str) -> str:
    """Origins with ``AGREE`` votes: a rare word votes once for an origin, so in
    sorted order an equal vote stands ``AGREE - 1`` places before."""
    return (f"array_distinct(filter({votes}, (o, i) -> "
            f"coalesce(get({votes}, i - {AGREE - 1}) = o, false)))")


def _verified(origins: str, phrases: tuple, text: str) -> str:
    """Whether each key phrase stands at its place from one of the origins."""
    return " AND ".join(
        f"exists({origins}, o -> {' OR '.join(_stands(p, f'o + {q}') for q in places(p, text))})"
        for p in phrases)


def _share(origins: str, text: str) -> str:
    """Largest share of a template's words in place from one of the origins."""
    words = text.split()
    in_place = " + ".join(f"if(get(words, o + {i}) = '{w}', 1, 0)" for i, w in enumerate(words))
    return f"coalesce(array_max(transform({origins}, o -> {in_place})), 0) / {len(words)}D"


def _joined(labels: list) -> str:
    """Distinct labels whose condition holds, in order."""
    found = ", ".join(f"if({hit}, '{label}', NULL)" for label, hit in labels)
    return f"array_join(array_sort(array_distinct(array_compact(array({found})))), ',')"


def scan(documents: DataFrame) -> DataFrame:
    """Every document with its base phrases, labels and score."""
    counts = document_counts(documents)
    index = [(label, text, phrases, rarest(text, counts, RARE)) for label, text, phrases in TEMPLATES]
    anchors = [(label, text, rarest(text, counts, 1)[0]) for label, text in BASE]
    looked_up = sorted({w for *_, rare in index for w in rare} | {w for *_, w in anchors})
    listed = ", ".join(f"'{w}'" for w in looked_up)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _words("text").alias("words"))
    rows = rows.withColumn("at", F.expr(
        "if(size(words) > 0, filter(sequence(0, size(words) - 1), "
        f"p -> get(words, p) IN ({listed})), array())"))
    rows = rows.withColumns({f"base{i}": F.expr(
        f"filter({_origins(anchor, text)}, o -> {_stands(text, 'o')})")
        for i, (_, text, anchor) in enumerate(anchors)})
    rows = rows.withColumns({f"votes{i}": F.expr(_votes(text, rare))
                             for i, (_, text, _, rare) in enumerate(index)})
    rows = rows.withColumns({f"from{i}": F.expr(_agreed(f"votes{i}")) for i in range(len(index))})
    rows = rows.withColumn("places", F.expr(
        f"concat({', '.join(f'base{i}' for i in range(len(BASE)))})"))
    base = [(label, f"size(base{i}) > 0") for i, (label, _) in enumerate(BASE)]
    more = [(label, _verified(f"from{i}", phrases, text))
            for i, (label, text, phrases, _) in enumerate(index)]
    shares = [f"if({hit}, 1D, 0D)" for _, hit in base] + [
        _share(f"from{i}", text) for i, (_, text, _, _) in enumerate(index)]
    return rows.selectExpr(
        "doc_id", "CAST(size(words) AS BIGINT) AS n_words", "CAST(size(places) AS BIGINT) AS n_base",
        "CAST(array_min(places) AS BIGINT) AS first_word",
        "CAST(array_max(places) AS BIGINT) AS last_word",
        f"{_joined(base)} AS base_labels", f"{_joined(base + more)} AS labels",
        f"greatest({', '.join(shares)}) AS score")
