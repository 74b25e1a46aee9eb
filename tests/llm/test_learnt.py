"""Classifiers: held-out accuracy, inputs, and odd rows."""

from zlib import crc32

import numpy as np
import pytest
from knowspark.llm import labelled, quality, text as T, toxicity

CLASSIFIERS = [(quality, "quality"), (toxicity, "toxic")]


@pytest.fixture(scope="module", params=CLASSIFIERS, ids=["quality", "toxicity"])
def scored(request, spark):
    module, label = request.param
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = module.classify(docs, labels).cache()
    return module, label, docs, labels, got


def test_held_out_accuracy(scored):
    module, label, docs, labels, got = scored
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r[label] for r in held)
    assert right >= 0.9 * len(held)
    limit = module.THRESHOLD
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in rows)


def test_labels_of_the_held_out_fold_teach_nothing(scored):
    """Turned round, they change no score."""
    module, label, docs, labels, got = scored
    turned = labels.selectExpr(
        "doc_id", *[f"CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - {c} "
                    f"ELSE {c} END AS {c}" for c in ("quality", "toxic")])
    again = module.classify(docs.select("doc_id", "text"), turned)
    assert {r.doc_id: r.score for r in again.collect()} == pytest.approx(
        {r.doc_id: r.score for r in got.collect()}, abs=1e-9)


@pytest.mark.parametrize("module,label", CLASSIFIERS, ids=["quality", "toxicity"])
def test_odd_rows(spark, docs_of, odd_docs, module, label):
    docs = docs_of(odd_docs)
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(1, 50)] + [(None, 1, 1), (5, None, None), (7, 1, 0)],
        "doc_id long, quality int, toxic int")
    rows = module.classify(docs, labels).collect()
    assert len(rows) == len(odd_docs) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(by_id[i]) == 1 for i in (10, 11, 12))
    assert len(module.classify(docs, labels.filter("doc_id < 0")).collect()) == len(odd_docs)
    assert module.classify(docs.filter("doc_id < 0"), labels).collect() == []


def test_spans_point_at_words(spark):
    rows = [(i, f"Ünder ten wörds {'idiot' if i % 2 else 'gentle'} and more of them {i}")
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(300)],
                                   "doc_id long, quality int, toxic int")
    for r in toxicity.classify(docs, labels).join(docs, "doc_id").collect():
        assert [r.text[s.start:s.end] for s in r.spans] == (["idiot"] if r.doc_id % 2 else [])
        assert r.predicted == r.doc_id % 2


def test_marginals_against_enumeration():
    """Forward-backward odds against all labellings of short chains."""
    rng = np.random.default_rng(1)
    weights = np.concatenate([rng.normal(size=1 << toxicity.BITS), rng.normal(size=toxicity.EXTRA)])
    places = rng.integers(0, 1 << toxicity.BITS, (6, 4))
    got = toxicity.marginals(places, np.array([0, 6]), weights)
    evidence, (start, *moves) = weights[:-5][places].sum(axis=1), weights[-5:]
    total, ones = 0.0, np.zeros(6)
    for code in range(64):
        y = [code >> k & 1 for k in range(6)]
        score = start * y[0] + sum(e * v for e, v in zip(evidence, y)) \
            + sum(moves[2 * a + b] for a, b in zip(y, y[1:]))
        total += np.exp(score)
        ones += np.exp(score) * np.array(y)
    assert np.allclose(got, ones / total)


def test_clean_keeps_columns(spark, docs_of, odd_docs):
    docs = docs_of(odd_docs).withColumnRenamed("key", "spans").withColumnRenamed("name", "most")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns and left.count() == len(odd_docs)


def test_words_are_those_of_the_pattern():
    import pyarrow as pa
    import brute
    texts = ["a  b\tc", None, "", "é\x0bß\x1cx", "end ", "no gap", "gap less"]
    for _, _, data, offsets in T.pieces(pa.array(texts)):
        starts, ends, bounds = T.word_bounds(data, offsets)
        raw = data.tobytes()
        found = [[raw[a:b].decode() for a, b in zip(starts[i:j], ends[i:j])]
                 for i, j in zip(bounds[:-1], bounds[1:])]
        assert found == [brute.words(t) for t in texts]


def test_a_sample_is_bounded_by_documents(spark):
    """Thousands of texts under one labelled id: no more than asked for, equal ones once."""
    rows = [(1, f"text {i % 1500}") for i in range(3000)] + [(i, "other") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, 1) for i in range(1, 30)], "doc_id long, quality int")
    got = labelled.sample(docs, marks, "quality", 10).collect()
    assert len(got) == 10 == len({(r.doc_id, r.text) for r in got})
    assert labelled.sample(docs, marks, "quality", 10 ** 6).count() == 1500 + sum(
        crc32(str(i).encode()) % 5 != 0 for i in range(2, 30))
