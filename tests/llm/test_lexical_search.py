"""Ranked search against a plain version of the formula."""

import collections
import math
import re

import pytest

from knowspark.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NULL_ID = -(1 << 63)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, queries, k):
    bags = [(NULL_ID if d is None else d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(q for q in queries if q[1] is not None):
        scores = []
        for d, b in bags:
            m = 10 + 90 * b.total() * n_docs // max(total, 1)
            scores.append((-sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t]), d))
        for rank, (s, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out.append((item, rank, None if d == NULL_ID else d, -s))
    return sorted(out, key=repr)


def run(spark, docs, queries, k=10, segment=lexical_search.SEGMENT_BYTES,
        block=lexical_search.BLOCK_BYTES):
    index = lexical_search.build_index(docs, segment)
    asked = spark.createDataFrame(queries, "item_id long, text string, q int, score string")
    found = lexical_search.search(index, asked, k, block)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"),
                            ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=repr)


QUERIES = [(1, "a b of the"), (2, "É naïve, W17 w17 w500 xx"), (3, None), (4, ""), (5, "!?"),
           (6, "nowhere found"), (7, "v3 v4 the"), (8, "another text"), (8, "word"), (None, "word"),
           (1, "a b of the")]


@pytest.mark.parametrize("segment, block, k", [(1 << 20, 1 << 20, 10), (700, 20, 3), (1, 1, 1)])
def test_as_the_formula(spark, docs_of, odd_docs, segment, block, k):
    asked = [(i, t, 0, "x") for i, t in QUERIES]
    assert run(spark, docs_of(odd_docs), asked, k, segment, block) == plain(odd_docs, QUERIES, k)


def test_long_lists_skip(spark, docs_of):
    """Common terms in thousands of documents: few are scored, the best are found."""
    docs = [(i, "the of and " * (1 + i % 7) + f"n{i}" + (" rare gem" if i % 900 == 0 else ""))
            for i in range(5000)]
    queries = [(1, "the of and"), (2, "the rare gem of n17"), (3, "and n4999 n0")]
    asked = [(i, t, 0, "x") for i, t in queries]
    assert run(spark, docs_of(docs, 2), asked) == plain(docs, queries, 10)


def test_ranges_below_the_floor_are_skipped():
    """The visit ends before most ranges where one range has all good documents."""
    import pyarrow as pa
    block = lexical_search._Block([1], ["common rare"])
    block.weigh(4096, {int(t): 4000 for t in block.terms})
    ids, rows, terms_ = list(range(4096)), [], []
    for i in range(4096):
        for t in block.terms.tolist() * (9 if i < 128 else 1):
            rows.append(i)
            terms_.append(t)
    import numpy as np
    batch = lexical_search._segment(0, [np.array(ids)], [np.array(terms_)], [np.array(rows)])
    segment = lexical_search._Segment(block, (4096, len(rows)), pa.record_batch(batch))
    seen = []
    real = segment.ids

    class Watched:
        def __len__(self):
            return len(real)

        def __getitem__(self, at):
            seen.append(at)
            return real[at]

    segment.ids = Watched()
    none = np.zeros(0, dtype=np.int64)
    scores, found = segment.best(block.asks[0], (none, none), 10)
    assert found.tolist() == list(range(10)) and len(seen) == 1


def test_nothing_to_find(spark, docs_of):
    asked = [(1, "a", 0, "x")]
    assert run(spark, docs_of([]), asked) == []
    assert run(spark, docs_of([(1, None), (2, "...")]), asked) == []
    assert run(spark, docs_of([(1, "a")]), []) == []
