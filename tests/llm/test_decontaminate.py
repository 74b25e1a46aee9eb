"""Edit matching against the plain dynamic programme."""

import random
import re

import brute
import pytest
from knowspark.llm import decontaminate as D


def edited(rnd, text, edits):
    for _ in range(edits):
        at, kind = rnd.randrange(len(text)), rnd.randrange(3)
        text = text[:at] + ("" if kind == 0 else rnd.choice("abc é")) + text[at + (kind != 1):]
    return text


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(k, prose(rnd.randint(8, 40))) for k in range(12)]
    docs = [(None, None), (900, ""), (901, "short")]
    for i in range(60):
        item = rnd.choice(items)[1]
        budget = int(D.RATE * len(D.normal(item)))
        inside = edited(rnd, item, rnd.randint(0, budget + 3)) if rnd.random() < 0.7 else prose(20)
        docs.append((i, f"{prose(30)} \n\t{inside.upper()}  {prose(30)}"))
    docs.append((902, prose(20_000) + " " + items[0][1]))
    docs.append(docs[5])
    return docs, items + [(None, items[0][1]), (77, None), (78, "tiny"), (0, items[1][1])]


def want(docs, items):
    out = []
    for doc_id, text in docs:
        for item_id, item in items:
            pattern = D.normal(item or "")
            if text and pattern and len(pattern) < D.SHORT:
                if re.search(rf"(?<![^\W_]){re.escape(pattern)}(?![^\W_])", D.normal(text)):
                    out.append((doc_id, item_id, 0))
            elif text and pattern:
                d = brute.distance_within(pattern, D.normal(text))
                if d <= int(D.RATE * len(pattern)):
                    out.append((doc_id, item_id, d))
    return brute.rows(out)


@pytest.mark.parametrize("block", [D.BLOCK_CHARS, 400])
def test_against_dynamic_programme(spark, docs_of, corpus, block, monkeypatch):
    docs, items = corpus
    small = [d for d in docs if d[0] != 902]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    got = D.find_leaks(docs_of(small), benchmark, "found", block)
    least = {}
    for n, r in enumerate(got.collect()):
        for x in r.found:  # ids with several texts are told apart by the budget
            key = (n, r.doc_id, x.item_id, x.budget)
            least[key] = min(x.distance, least.get(key, 99))
    rows = [(doc, item, d) for (_, doc, item, _), d in least.items()]
    assert brute.rows(rows) == want(small, items)
    for r in got.collect():
        for x in r.found:
            stretch, item = D.normal(r.text)[x.start:x.end], dict(items[:12]).get(x.item_id)
            if item:
                assert min(brute.distance_within(D.normal(i), stretch) for k, i in items
                           if k == x.item_id and i) <= x.distance


def test_clean_and_long_text(spark, docs_of, corpus):
    docs, items = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = docs_of(docs)
    left = D.clean(frame, benchmark)
    assert left.columns == frame.columns
    kept = {r.doc_id for r in left.collect()}
    assert 902 not in kept and {None, 900, 901} <= kept


def test_short_items_stand_between_word_borders(spark, docs_of):
    items = [(1, "capital of x"), (2, "Of"), (3, " \t "), (4, "?!")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "The Capital \n of X, said often; of X"), (2, "a capital of xy offers"), (3, "why ?!")]
    got = sorted(tuple(r) for r in D.matches(docs_of(docs), benchmark).select(
        "doc_id", "item_id", "distance", "start", "end").collect())
    assert got == [(1, 1, 0, 4, 16), (1, 2, 0, 12, 14), (1, 2, 0, 30, 32), (2, 2, 0, 10, 12),
                   (3, 4, 0, 4, 6)]


def test_every_place_is_reported(spark, docs_of):
    item = "a passage of the benchmark that is long enough to have edits to spare"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    text = f"{item} and {'other words ' * 20} {item.replace('long', 'lng')} end"
    got = D.matches(docs_of([(5, text)]), benchmark).collect()
    assert [(r.distance, r.start) for r in sorted(got, key=lambda r: r.start)] == [
        (0, 0), (1, D.normal(text).rindex("a passage"))]


def test_one_block_at_a_time(spark, docs_of, corpus):
    """A benchmark of many blocks: the stage that is left holds one automaton."""
    docs, items = corpus
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_leaks(docs_of(docs[:20]), benchmark, "found", 300)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    whole = D.find_leaks(docs_of(docs[:20]), benchmark, "found")
    key = lambda r: (r.doc_id, sorted(map(repr, r.found)))
    assert sorted(map(repr, map(key, got.collect()))) == sorted(map(repr, map(key, whole.collect())))


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of([(1, "some text")])
    assert D.matches(docs, none).collect() == []
    one = spark.createDataFrame([(1, "a text of the benchmark itself")], "item_id long, text string")
    assert D.matches(docs.filter("doc_id = 2"), one).collect() == []


def test_pieces_cover_the_item():
    for size in (20, 81, 300):
        bounds = D.piece_bounds(size, int(D.RATE * size))
        assert bounds[0][0] == 0 and bounds[-1][1] == size
        assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
