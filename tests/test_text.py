"""Chunking, tags and text rules on small inline texts."""

import random

import pytest
from pyspark.sql import functions as F

from knowspark.functions import text
from knowspark.operators import ingest

LONG = "This is paragraph number {} with enough content to pass the minimum length."


def chunks(spark, content, kind="note"):
    df = spark.createDataFrame([("a", content, kind)], "id string, content string, content_type string")
    rows = ingest.chunk(df).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert {r["total_chunks"] for r in rows} == {len(rows)}
    return [r["text"] for r in rows]


@pytest.mark.parametrize("kind", ["thought", "event", "memo", None])
def test_other_types_stay_whole(spark, kind):
    content = "  a\n\n" + LONG.format(1) + "\n\n" + LONG.format(2)
    assert chunks(spark, content, kind) == [content]


def test_note_is_cut_at_blank_lines(spark):
    parts = [LONG.format(i) for i in range(3)]
    assert chunks(spark, "\n\n".join(parts)) == parts


def test_short_paragraphs_are_dropped_beside_long_ones(spark):
    assert chunks(spark, "Short.\n\n " + LONG.format(1) + "\n \n\nTail") == [LONG.format(1)]


def test_only_short_paragraphs_stay_whole_and_stripped(spark):
    assert chunks(spark, " Short.\n\nAlso short.  \x1f") == ["Short.\n\nAlso short."]


def test_long_note_without_paragraphs_is_windowed(spark):
    got = chunks(spark, "\n\n".join(["w"] * 600))
    assert [len(c.split()) for c in got] == [500, 150]


def test_long_paragraphs_win_over_windows(spark):
    assert len(chunks(spark, "\n\n".join(["word " * 60] * 10))) == 10


@pytest.mark.parametrize("n,windows", [(500, 1), (501, 2), (950, 2), (951, 3), (1400, 3), (1401, 4)])
def test_window_count(spark, n, windows):
    got = chunks(spark, "\n\n".join(f"w{i}" for i in range(n)))
    assert len(got) == windows
    if windows > 1:
        assert got[-1].split()[-1] == f"w{n - 1}"
        assert got[1].split()[0] == "w450"


def test_boundary_of_fifty_characters(spark):
    assert chunks(spark, "a" * 49 + "\n\n" + "b" * 50) == ["b" * 50]
    assert chunks(spark, "a" * 49 + "\n\n" + "b" * 49) == ["a" * 49 + "\n\n" + "b" * 49]
    assert chunks(spark, "é" * 50 + "\n\nx") == ["é" * 50]


def expected_chunks(content):
    """The rule in plain Python, by counting."""
    kept = [p for p in map(str.strip, content.split("\n\n")) if len(p) >= 50]
    if kept:
        return kept
    tokens = content.split()
    if len(tokens) <= 500:
        return [content.strip()]
    found, at = [], 0
    while True:
        found.append(" ".join(tokens[at:at + 500]))
        if at + 500 >= len(tokens):
            return found
        at += 450


def test_random_notes_match_the_rule(spark):
    rng = random.Random(5)
    gaps = [" ", "\n", "\n\n", "\n\n\n", "\t", " ", " ", "\x1c", "\x85", " \n\n "]
    texts = []
    for _ in range(300):
        n = rng.choice([0, 1, 5, 40, 499, 500, 501, 949, 951, 1500])
        gap = rng.choices(gaps, k=3)
        texts.append("".join(
            rng.choice(gap) + "é" * rng.choice([1, 3, 8, rng.choice([3, 60])]) for _ in range(n))
            + rng.choice(["", " ", "\n\n"]))
    df = spark.createDataFrame(
        [(str(i), t, "note") for i, t in enumerate(texts)],
        "id string, content string, content_type string")
    got = {r["id"]: r["chunks"] for r in ingest.chunk_arrays(df).collect()}
    for i, t in enumerate(texts):
        assert got[str(i)] == expected_chunks(t)


def test_sliding_takes_any_length(spark):
    df = spark.createDataFrame([("a", "x y z"), ("b", " \n ")], "id string, content string")
    rows = {(r["id"], r["chunk_index"]): r["text"]
            for r in ingest.chunk_sliding(df, size=2, overlap=1).collect()}
    assert rows == {("a", 0): "x y", ("a", 1): "y z", ("b", 0): " \n "}


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(
        f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
    return df.select(expr).first()[0]


@pytest.mark.parametrize("raw,tag", [
    ("Travel", "travel"), ("#Work-Stuff", "work-stuff"), ("café notes!", "cafnotes"),
    ("multi word", "multiword"), ("a" * 50, "a" * 40), ("  ", ""), ("a_b-9", "a_b-9")])
def test_normalize_tag(spark, raw, tag):
    assert one(spark, text.normalize_tag("c0"), raw) == tag


def test_clean_tags(spark):
    assert one(spark, text.clean_tags("c0", 5), ["Work", "#Work", "", None, "ideas"]) == [
        "work", "ideas"]
    many = [f"tag{i}" for i in range(30)]
    assert one(spark, text.clean_tags("c0"), many) == many[:20]


def test_embed_text_skips_empty_but_content_keeps_the_newline(spark):
    assert one(spark, text.embed_text("c0", "c1"), "head", "") == "head"
    assert one(spark, text.embed_text("c0", "c1"), "head", None) == "head"
    assert one(spark, text.item_content("c0", "c1"), "head", "") == "head\n"
    assert one(spark, text.item_content("c0", "c1"), "head", None) == "head"


@pytest.mark.parametrize("content,kind", [
    ("x", "thought"), (LONG.format(1), "thought"),
    (LONG.format(1) + "\n\n" + LONG.format(2), "note"),
    ("w " * 500, "thought"), ("w " * 501, "note")])
def test_detect_type(spark, content, kind):
    assert one(spark, text.detect_type("c0"), content) == kind


def test_whitespace_sets():
    assert all(c.isspace() for c in text.PY_SPACE)
    assert "\x85" in text.PY_SPACE and "\x85" not in text.JS_SPACE
    assert "﻿" in text.JS_SPACE and "﻿" not in text.PY_SPACE


def test_stable_uuid(spark):
    df = spark.range(3)
    first = [r[0] for r in df.select(text.stable_uuid("id", F.lit(0))).collect()]
    again = [r[0] for r in df.repartition(3).orderBy("id").select(
        text.stable_uuid("id", F.lit(0))).collect()]
    assert first == again and len(set(first)) == 3
    assert all(len(u) == 36 and u.count("-") == 4 for u in first)
