"""The manifest against a plain tree, and its SQL with small parts."""

import hashlib
import zlib

import duckdb
import pytest

from knowspark.llm import merkle
from knowspark.llm.oracle import ORACLE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    """Of leaf ``i``: before and after on every level."""
    out = []
    for level in levels[:-1]:
        run, k = level[i // 16 * 16:i // 16 * 16 + 16], i % 16
        out.append(("".join(run[:k]), "".join(run[k + 1:])))
        i //= 16
    return out


def plain(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    first = lambda v: (v is not None, v if v is not None else 0)
    sources, out = {}, []
    for row in rows:
        sources.setdefault(row[1], []).append((first(row[0]), leaf(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[1] for x in sorted(sources[s], key=lambda x: x[:2])]) for s in order}
    upper = climb([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (_, own, row) in enumerate(sorted(sources[s], key=lambda x: x[:2])):
            steps = way(trees[s], i) + way(upper, k)
            now = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                now = leaf((*row[:4], row[4] and row[4].translate(LOWER)))
            for before, after in steps:
                now = sha(before, now, after)
            out.append((row[0], own, trees[s][-1][0], upper[-1][0],
                        sha(*(b + a for b, a in steps)), now, now == upper[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def run(spark, rows, height, parts=3):
    full = [(*r, 1, 2, "x", "y") for r in rows]
    docs = spark.createDataFrame(full, SCHEMA + ", part int, n int, leaf string, root string")
    got = merkle.verify(docs.repartition(parts), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                           "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def rows_of(sizes):
    return [(i * 7 % 1000 + 1000 * k, s, None if i % 5 else "en", i if i % 3 else None,
             None if i % 11 == 3 else "Text É %d" % i if i % 2 else "") for k, (s, n) in
            enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("height, sizes", [
    (1, [("a", 300), (None, 17), ("b", 1), ("é", 16), ("", 33)]),  # a hot source, several rounds
    (0, [("a", 40), ("b", 2)]),
    (3, [(f"s{i}", 1 + i % 3) for i in range(40)]),  # an upper tree of two rounds
    (3, [("only", 1)]),
])
def test_as_a_plain_tree(spark, height, sizes):
    rows = rows_of(sizes)
    assert run(spark, rows, height) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "a", "en", 3, "Abc"),
            (1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "abd"), (None, "a", None, 0, ""),
            (5, "a", "x", 1, "Q" * 300_000), (-3, "a", "x", 1, "Z")]
    assert run(spark, rows, 1) == plain(rows)
    assert run(spark, [], 1) == []


def test_small_parts_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * REPLACE ('s'||(doc_id % 3) AS source) FROM '{path}'")
    from pyspark.sql import functions as F
    docs = spark.read.parquet(path).withColumn("source", F.concat(
        F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    got = merkle.verify(docs, 1)
    want = duck.execute(ORACLE["op12_merkle"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_proofs_lead_to_the_root(spark):
    rows = rows_of([("a", 70), ("b", 20)])
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), height=1)
    bad = found.filter(merkle.folded("leaf") != found["root"]).count()
    assert bad == 0 and found.count() == 90
