"""The pipeline's stages on a small corpus with planted cases."""

import random
from collections import Counter

import pytest

import brute
import corpus_pipeline
from knowspark.llm import decontaminate


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(4)
    prose = lambda n: " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(n))
    items = [(k, prose(30)) for k in range(5)]
    docs, labels = [], []
    for i in range(300):
        text = prose(rnd.randint(40, 90))
        if i % 5 == 1:
            text += " you idiot " + prose(5) + " idiot"
        elif i % 5 == 2:
            text = " ".join(f"{w}||##" for w in text.split())
        elif i % 25 == 3:
            text = docs[i - 3][1]  # a copy of a clean one
        elif i % 25 == 4:
            text += " " + items[i % 4][1]
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 5 != 2), int(i % 5 == 1)))
    docs += [(None, None, None, None, None), (900, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("corpus")
    for name, rows, schema in (
            ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
            ("labels", labels, "doc_id long, quality int, toxic int"),
            ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path), docs, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, [{r[0] for r in rows}]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen.append(Counter(r.doc_id for r in docs.collect()))
        if name != "sharding":
            assert docs.columns == columns
    toxic, near, clean, mixed, shards = (set(s) for s in seen[1:])
    planted = {i for i in range(300) if i % 5 == 1}
    assert planted <= seen[0] - toxic and len(seen[0] - toxic - planted) <= 2
    brute_kept = {r[0] for r in brute.near_components(
        [(r[0], r[1]) for r in rows if r[0] in toxic]) if r[3]}
    assert near == brute_kept
    assert near - clean == {r[0] for r in rows if r[0] in near and r[1] and any(
        decontaminate.normal(i) in r[1] for _, i in items)}
    assert {i for i in clean if i is not None and i < 300 and i % 5 != 2} <= mixed <= clean
    assert len(mixed) < len(clean)
    assert seen[-1] == seen[-2]


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder[0])
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert corpus_pipeline.ORACLE_SQL is None


def odd_folder(spark, tmp_path, docs, labels=(), items=()):
    for name, rows, schema in (
            ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long, "
                                "leaks string, membership int, expected double, c long, shard string"),
            ("labels", list(labels), "doc_id long, quality int, toxic int"),
            ("benchmark", list(items), "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_empty_tables(spark, tmp_path):
    path = odd_folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, path).collect() == []


def test_odd_rows_and_clashing_names(spark, tmp_path):
    """Repeated rows, texts that share an id, no id, a very long text; no labels."""
    rest = ("en", "s", 1, "l", 2, 3.0, 4, "x")
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows = [(1, "one text of its own here", *rest)] * 3 + [(2, "first text under two", *rest),
            (2, "second text under two", *rest), (None, None, *rest), (None, "no id at all", *rest),
            (3, long, *rest), (4, "", *rest)]
    path = odd_folder(spark, tmp_path, rows, [], [(1, "no id at all"), (2, None)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen[name] = Counter(r.doc_id for r in docs.collect())
        assert name == "sharding" or docs.columns == columns
    assert seen["toxicity"] == Counter(r[0] for r in rows)
    assert seen["near_duplicates"] == Counter({1: 1, 2: 2, None: 2, 3: 1, 4: 1})
    assert seen["decontamination"] == Counter({1: 1, 2: 2, None: 1, 3: 1, 4: 1})
    assert set(seen["sharding"]) <= {1, 2, None, 3, 4}
