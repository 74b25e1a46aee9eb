"""Near duplicates against all pairs."""

import random

import numpy as np

import brute
from knowspark.llm import near_dup
from knowspark.llm.components import components


def copies(seed=3, groups=25):
    rnd, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 2, 3, 40])):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 9999)}"
            text = " ".join(w)
            rows.append((len(rows), text.upper() if rnd.random() < 0.2 else text))
    return rows


def test_against_all_pairs(docs_of):
    rows = copies()
    rows += [(None, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (None, "a b"),
             rows[0], rows[1], (rows[2][0], "other text altogether for one id"),
             (9005, " ".join(f"l{i % 977}" for i in range(50_000)))]
    got = near_dup.near_duplicates(docs_of(rows))
    assert brute.rows(got.collect()) == brute.near_components(rows)


def test_large_nodes(docs_of, monkeypatch):
    """Nodes beyond the small size: pivots, further levels, then blocks."""
    monkeypatch.setattr(near_dup, "SMALL", 16)
    monkeypatch.setattr(near_dup, "COLUMNS", 64)
    monkeypatch.setattr(near_dup, "LEVELS", 2)
    rows = copies(5, 8)
    got = near_dup.near_duplicates(docs_of(rows))
    assert brute.rows(got.collect()) == brute.near_components(rows)


def test_one_of_each(docs_of):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "h i j k l m n"), (3, "h i j k l m n"),
            (4, None), (5, ""), (None, "o p q r s t u"), (None, "o p q r s t u")]
    docs = docs_of(rows)
    got = near_dup.one_of_each(docs)
    assert got.columns == docs.columns
    assert brute.rows(got.select("doc_id", "text").collect()) == brute.rows(
        [(1, "a b c d e f g"), (3, "h i j k l m n"), (4, None), (5, ""), (None, "o p q r s t u")])


def test_empty_table(docs_of):
    assert near_dup.near_duplicates(docs_of([(1, "a")]).filter("doc_id = 2")).collect() == []


def test_connected_sets():
    """Sets chained by similar neighbours are one; others stay alone."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 40, 9000).astype(np.uint64)
    chain = [np.unique(np.concatenate([base[k * 200:k * 200 + 4000], base[8000:8010]]))
             for k in range(6)]
    sets = [chain[3], base[:10], *chain[:3], base[8990:], *chain[4:]]
    assert near_dup.connected(sets).tolist() == [0, 1, 0, 0, 0, 5, 0, 0]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.c: r.comp for r in got.collect()} == {
        **{i: 0 for i in range(31)}, **{100 + k: 100 for k in range(40)}}


def pair_at(rng, size=140):
    """Two sets of which three quarters of the union are shared."""
    union = rng.integers(0, 1 << 64, size, dtype=np.uint64)
    shared, own = size * 3 // 4, size // 8
    return union[:shared + own], np.append(union[:shared], union[shared + own:shared + 2 * own + 1])


def test_paths_of_a_pair_do_not_die_out():
    """At similarity 0.75 a pair still shares a node at level 20."""
    rng, lost, pairs = np.random.default_rng(8), 0, 300
    for _ in range(pairs):
        sets = [np.sort(s) for s in pair_at(rng)]
        values = np.concatenate(sets)
        bounds = np.array([0, len(sets[0]), len(values)])
        sig = near_dup.signatures(values, bounds)
        shared = np.array([n[0] for n in near_dup._roots(sig, near_dup.TREES) if n[0] == n[1]])
        for _ in range(19):
            shared = np.intersect1d(*(near_dup._children(
                shared, np.full(len(shared), i), values, bounds)[1] for i in (0, 1)))[:400]
        lost += not len(shared)
    assert lost <= 1


def test_texts_without_ids_do_not_meet_each_other(spark, docs_of):
    """Hundreds of texts under no id: told apart, and joined one to one."""
    rows = [(None, " ".join(f"w{i * 3 // 4 * 40 + k}" for k in range(40 - i % 2)))
            for i in range(300)] + [(None, None)] * 3
    got = near_dup.near_duplicates(docs_of(rows))
    assert brute.rows(got.collect()) == brute.near_components(rows)
    classes = near_dup.identified(docs_of(rows)).select("d", "t", "text").distinct()
    assert classes.groupBy("d", "t").count().filter("count > 1").isEmpty()
