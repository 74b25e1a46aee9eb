"""Substring deduplication by words and by bytes, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from knowspark.llm import repeats, substring_dedup, suffix_dedup, text as T


def test_words_against_brute_force(docs_of, odd_docs):
    got = substring_dedup.remove_repeats(docs_of(odd_docs))
    assert brute.rows(got.collect()) == brute.word_repeats(odd_docs)


def test_bytes_against_brute_force(docs_of, odd_docs):
    rows = [r for r in odd_docs if r[0] != 60] + [(60, odd_docs[-1][1][:30_000])]
    got = suffix_dedup.remove_repeats(docs_of(rows))
    assert brute.rows(got.collect()) == brute.byte_repeats(rows)


@pytest.mark.parametrize("operator,expected", [
    (substring_dedup, brute.word_repeats), (suffix_dedup, brute.byte_repeats)])
def test_hot_passages(docs_of, operator, expected, monkeypatch):
    """One passage in every document: announced names and single windows."""
    monkeypatch.setattr(repeats, "LOCAL", 2)
    monkeypatch.setattr(repeats, "FEW", 3)
    rnd = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, " ".join([*(f"r{rnd.randint(0, 9999)}" for _ in range(rnd.randint(0, 9))), passage,
                          *(f"r{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 9)))]))
            for i in range(80)]
    got = operator.remove_repeats(docs_of(rows, 6))
    assert brute.rows(got.collect()) == expected(rows)


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_empty_table(docs_of, operator):
    empty = docs_of([(1, "a")]).filter("doc_id = 2")
    assert operator.remove_repeats(empty).collect() == []


def test_names_agree_inside_equal_passages():
    """The middle word of a window has the same symbol whatever stands around."""
    rnd = np.random.default_rng(4)
    half = (substring_dedup.WIDTH - 1) // 2
    for _ in range(300):
        window = rnd.integers(0, rnd.integers(2, 60), substring_dedup.WIDTH)
        seen = set()
        for _ in range(4):
            before, after = (rnd.integers(0, 5, rnd.integers(0, 20)) for _ in range(2))
            words = T.mix(np.concatenate([before, window, after]).astype(np.uint64))
            names, at, _ = substring_dedup.recompress(
                words, np.array([0, len(words)]), substring_dedup.ROUNDS, substring_dedup.CAP)
            seen.add(int(names[np.searchsorted(at, len(before) + half, "right") - 1]))
        assert len(seen) == 1


@pytest.mark.parametrize("operator,expected", [
    (substring_dedup, brute.word_repeats), (suffix_dedup, brute.byte_repeats)])
def test_many_texts_under_one_id(docs_of, operator, expected, monkeypatch):
    """Texts that share a doc_id, or have none, keep their own ranges and one list each."""
    lists, apply = [], repeats.apply_ranges

    def seen(parser, documents, ranges, emit, schema):
        keys = [c for c in ranges.columns if c != "at"]
        lists.append(max(r["n"] for r in ranges.distinct().groupBy(*keys).agg(
            F.count("at").alias("n")).collect()))
        return apply(parser, documents, ranges, emit, schema)

    monkeypatch.setattr(repeats, "apply_ranges", seen)
    rnd = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage) for i in range(2)]
    rows += [(7 if k % 2 else None, f"{rnd.randint(0, 10**9)} {passage} r{rnd.randint(0, 10**9)}")
             for k in range(120)]
    rows += [(7, rows[3][1])] * 5
    got = operator.remove_repeats(docs_of(rows))
    assert brute.rows(got.collect()) == expected(rows)
    size = len if operator is suffix_dedup else lambda text: len(text.split())
    windows = max(size(text) for _, text in rows) - operator.WIDTH + 1
    assert lists[0] <= 2 * windows  # each window alone and as part of its whole unit
