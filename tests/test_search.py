"""Vector search against brute force, in blocks, with odd vectors, approximate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knowspark.functions.vectors import unit_rows
from knowspark.operators import search, tags, vector_index
from knowspark.operators.search import Grid
from knowspark.session import new_work_path

DIMS = 16


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    found = rng.standard_normal((240, DIMS)).astype(np.float32)
    found[100:180] = found[99]  # a third of the items are copies of one
    found[7] = 0
    return found


@pytest.fixture(scope="module")
def made(make_store, vectors):
    """Items of all four tables; tags x, y, z; some without tags or vectors."""
    def row(i, **more):
        label = [["x"], ["x", "y"], ["z", "z"], None, [], ["y", None]][i % 6]
        vector = None if i % 50 == 49 else [float(v) for v in vectors[i]]
        return dict(id=f"i{i:03d}", tags=label, embedding=vector, **more)
    n = range(240)
    return make_store(
        thoughts=[row(i, content="c", content_type="note") for i in n if i % 4 == 0],
        tasks=[row(i, title="t") for i in n if i % 4 == 1],
        contacts=[row(i, name="n") for i in n if i % 4 == 2],
        home_items=[row(i, name="n") for i in n if i % 4 == 3])


def expected(vectors, query, keep, k):
    scored = []
    for i in range(240):
        if i % 50 == 49 or not vectors[i].any() or not keep(i):
            continue
        a, b = vectors[i].astype(float), np.asarray(query, dtype=float)
        scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), f"i{i:03d}"))
    return [(name, -s) for s, name in sorted(scored)[:k]]


def rows(df):
    return [(r["id"], round(r["similarity"], 9)) for r in df.collect()]


def test_search_with_copies(made, vectors):
    q = [float(v) for v in vectors[99]]
    assert rows(search.search(made, q, 30)) == expected(vectors, q, lambda i: True, 30)
    assert rows(search.search(made, q, 5, "task")) == expected(vectors, q, lambda i: i % 4 == 1, 5)
    assert rows(search.search_thoughts(made, q, 5)) == expected(
        vectors, q, lambda i: i % 4 == 0, 5)
    assert rows(search.search(made, q, 500)) == expected(vectors, q, lambda i: True, 500)


def test_zero_query_finds_nothing(made):
    assert search.search(made, [0.0] * DIMS).count() == 0


def test_dimension_mismatch_fails(made):
    with pytest.raises(Exception, match="expected vectors of 3 dimensions"):
        search.search(made, [1.0, 2.0, 3.0]).collect()


def batch(spark, vectors):
    return spark.createDataFrame(
        [(f"q{i}", [float(v) for v in vectors[i]]) for i in range(0, 120, 3)]
        + [("none", None), ("zero", [0.0] * DIMS)], "query_id string, vector array<float>")


@pytest.mark.parametrize("grid", [None, Grid(1, 1), Grid(4, 1), Grid(3, 5)])
def test_batch_is_many_searches(spark, made, vectors, grid):
    hits = search.search_batch(made, batch(spark, vectors), 6, grid=grid).collect()
    for i in range(0, 120, 3):
        if vectors[i].any():
            mine = sorted((r["rank"], r["id"], round(r["similarity"], 9))
                          for r in hits if r["query_id"] == f"q{i}")
            assert [(name, s) for _, name, s in mine] == expected(
                vectors, vectors[i], lambda i: True, 6)
    assert {r["query_id"] for r in hits}.isdisjoint({"none", "zero"})


def test_small_score_blocks(spark, made, vectors, monkeypatch):
    monkeypatch.setattr(search, "SCORE_CELLS", 50)
    hits = search.search_batch(made, batch(spark, vectors), 4)
    whole = {(r["query_id"], r["rank"]): r["id"] for r in hits.collect()}
    monkeypatch.undo()
    again = search.search_batch(made, batch(spark, vectors), 4)
    assert whole == {(r["query_id"], r["rank"]): r["id"] for r in again.collect()}


def test_best_are_exact_with_ties():
    rng = np.random.default_rng(0)
    scores = np.round(rng.random((400, 3)), 2)  # many ties
    scores[5] = np.nan
    names = np.array([f"n{i:03d}" for i in rng.permutation(400)])
    row, col = search._best_of(names, scores, 5)
    for q in range(3):
        want = sorted(zip(-np.nan_to_num(scores[:, q], nan=-9), names))[:5]
        assert [(-scores[r, q], names[r]) for r in row[col == q]] == want


def test_held_blocks(spark, made, vectors, monkeypatch):
    """Items are multiplied a block at a time; the best of all blocks stay."""
    part = search._Part(0)
    held = made.thoughts.filter("embedding IS NOT NULL").select("id", "embedding", "tags").toArrow()
    asked = batch(spark, vectors).filter("vector IS NOT NULL").select(
        F.col("query_id").alias("id"), F.col("vector").cast("array<double>")).toArrow()

    def found():
        part = search._Part(0)
        part.hold(held.combine_chunks().to_batches()[0])
        return [b.to_pydict() for b in part.find(asked.combine_chunks().to_batches()[0], 5)]

    whole = found()
    monkeypatch.setattr(search, "HELD_ROWS", 7)
    monkeypatch.setattr(search, "SCORE_CELLS", 50)
    assert found() == whole and whole[0]["id"] and not part.blocks


def test_grid_follows_both_sizes():
    """A part's share of the items is bounded; the smaller side is copied more often."""
    assert search.grid_for(1000, 10**6, 16, 1536) == Grid(1, 16)
    assert search.grid_for(10**6, 10, 16, 1536).cols == 1
    even = search.grid_for(10**4, 10**4, 64, 1536)
    assert even == Grid(8, 8)
    huge = search.grid_for(10**9, 10**5, 200, 1536)
    assert 10**9 * 1536 / huge.rows <= search.HELD_BYTES
    for items, queries in ((0, 0), (1, 0), (0, 5), (10**9, 10**9)):
        grid = search.grid_for(items, queries, 8, 1536)
        assert grid.rows >= 1 and 1 <= grid.cols <= 8


def test_no_side_reaches_all_parts(spark, made, vectors, monkeypatch):
    """Of 3 x 4 parts an item reaches 4 and a query 3; every pair meets once."""
    dealt, real = [], search.nearest_in_parts

    def seen(items, queries, *more):
        dealt.append((items.select("id", "part").toPandas(), queries.select("id", "part").toPandas()))
        return real(items, queries, *more)

    monkeypatch.setattr(search, "nearest_in_parts", seen)
    search.search_batch(made, batch(spark, vectors), 3, grid=Grid(3, 4))
    items, queries = dealt[0]
    assert set(items.groupby("id").part.nunique()) == {4} and items.part.nunique() == 12
    assert set(queries.groupby("id").part.nunique()) == {3}
    met = items.merge(queries, on="part")
    assert not met.duplicated(["id_x", "id_y"]).any()
    assert len(met) == items.id.nunique() * queries.id.nunique()


def test_batches_start_no_job(spark, made, vectors):
    """Query vectors never pass the driver: on a given grid nothing runs before the
    result is read."""
    queries = batch(spark, vectors)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        search.search_batch(made, queries, 3, grid=Grid(2, 2))
        search.suggest_all(made, 3, grid=Grid(2, 2))
        assert tracker.getJobIdsForGroup("lazy") == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_batch_of_one_type(spark, made, vectors):
    hits = search.search_batch(made, batch(spark, vectors), 3, content_type="task").collect()
    assert hits and all(int(r["id"][1:]) % 4 == 1 for r in hits)


def test_no_queries(spark, made):
    empty = spark.createDataFrame([], "query_id string, vector array<float>")
    assert search.search_batch(made, empty).count() == 0


def test_with_items(spark, made, vectors):
    hits = search.search_batch(made, batch(spark, vectors), 2)
    full = search.with_items(hits, made)
    assert full.count() == hits.count()
    assert "BroadcastHashJoin" in full._jdf.queryExecution().executedPlan().toString()
    assert {"title", "tags", "query_id", "rank"} <= set(full.columns)


def centroid(vectors, tag):
    mine = [vectors[i].astype(float) for i in range(240)
            if i % 50 != 49 and tag in {0: "x", 1: "xy", 2: "z", 5: "y"}.get(i % 6, "")]
    return np.mean(mine, axis=0)


def test_centroids(made, vectors):
    got = {r["tag"]: r["centroid"] for r in tags.tag_centroids(made).collect()}
    assert set(got) == {"x", "y", "z"}
    for tag in "xyz":
        assert np.allclose(got[tag], centroid(vectors, tag))
        assert np.allclose(tags.tag_centroid(made, tag).first()["centroid"], got[tag])
    assert tags.tag_centroid(made, "none").count() == 0


def untagged(tag):
    """Known not to carry it: tags present, no match, no NULL element."""
    return lambda i: i % 6 in {"x": (2, 4), "y": (0, 2, 4), "z": (0, 1, 4)}[tag]


def test_suggestions(made, vectors):
    every = search.suggest_all(made, 7).collect()
    for tag in "xyz":
        want = expected(vectors, centroid(vectors, tag), untagged(tag), 7)
        assert rows(search.suggested_connections(made, tag, 7)) == want
        mine = sorted((r["rank"], r["id"], round(r["similarity"], 9))
                      for r in every if r["tag"] == tag)
        assert [(name, s) for _, name, s in mine] == want
    assert search.suggested_connections(made, "none").count() == 0


def test_suggestions_of_some_tags(spark, made):
    wanted = spark.createDataFrame([("z",), ("none",)], "tag string")
    assert {r["tag"] for r in search.suggest_all(made, 3, wanted).collect()} == {"z"}


def ids_of(hits):
    return {(r["query_id"], r["id"]) for r in hits.collect()}


def test_approximate_search(spark, made, vectors):
    index = vector_index.build_index(made, new_work_path(spark, "index"))
    queries = batch(spark, vectors)
    exact = ids_of(search.search_batch(made, queries, 10))
    assert ids_of(vector_index.search_approx(spark, index, queries, 10, similarity=-1)) == exact
    again = vector_index.open_index(spark, index.path)
    some = ids_of(vector_index.search_approx(spark, again, queries, 10))
    assert len(some & exact) / len(exact) > 0.9
    assert ids_of(vector_index.search_approx(spark, index, queries, 10, grid=Grid(3, 2))) == some
    assert index.items(spark).count() == 235  # 5 have no vector or a zero vector


def apart(vectors, others):
    """Planes in which unit vectors differ."""
    drawn = vector_index.planes(vector_index.BITS, vectors.shape[1])
    a, b = (unit_rows(x) @ drawn.T >= 0 for x in (vectors, others))
    return (a[:, None, :] != b[None, :, :]).sum(axis=2)


def test_only_probed_pairs_are_scored(spark, made, vectors):
    index = vector_index.build_index(made, new_work_path(spark, "index"))
    one = batch(spark, vectors).filter("query_id = 'q0'")
    kept = [i for i in range(240) if i % 50 != 49 and vectors[i].any()]
    far = apart(vectors[:1].astype(float), vectors[kept].astype(float))[0]
    for similarity in (0.9, 0.25):
        differ = vector_index.differing(similarity=similarity)
        want = {("q0", f"i{i:03d}") for i, n in zip(kept, far) if n <= differ}
        assert ids_of(vector_index.search_approx(spark, index, one, 1000, similarity)) == want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(sf):
    """The registered parameters, by numpy: recall of the top 10 and pairs multiplied."""
    import pyarrow.parquet as pq
    rows = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")["embedding"]
    found = unit_rows(np.array(rows.to_pylist(), dtype=float))
    best = np.argsort(-np.round(found @ found.T, 12), axis=1, kind="stable")[:, :10]
    probed = np.concatenate([apart(found[i:i + 100], found) for i in range(0, len(found), 100)]) \
        <= vector_index.differing()
    assert np.take_along_axis(probed, best, 1).mean() >= 0.9
    assert probed.mean() < 1 / 3


def test_registered_search_has_recall(spark, sf_dir):
    from knowspark.plans.queries import QUERIES
    exact = ids_of(QUERIES["search_batch"](spark, sf_dir))
    assert len(ids_of(QUERIES["search_approx"](spark, sf_dir)) & exact) / len(exact) >= 0.9


def test_differing_planes():
    assert vector_index.differing(256, 1.0) == 0 and vector_index.differing(64, -1.0) == 64
    assert vector_index.differing(256, 0.9) < vector_index.differing(256, 0.5) < 128


# Pivots ------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 6, 300])
def test_pruned_search_is_exact(spark, made, vectors, k):
    queries = batch(spark, vectors)

    def all_of(hits):
        return sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 9))
                      for r in hits.collect())

    assert all_of(vector_index.search_pruned(made, queries, k)) == all_of(
        search.search_batch(made, queries, k))


def test_pruned_search_of_one_type_and_none(spark, make_store, made, vectors):
    queries = batch(spark, vectors)
    assert ids_of(vector_index.search_pruned(made, queries, 3, content_type="task")) == ids_of(
        search.search_batch(made, queries, 3, content_type="task"))
    assert vector_index.search_pruned(make_store(), queries, 3).count() == 0
    assert vector_index.search_pruned(made, queries.limit(0), 3).count() == 0


def test_pruned_search_multiplies_few_pairs(spark, make_store, monkeypatch):
    """Forty clusters: of all pairs less than an eighth is multiplied."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, DIMS))
    made = np.repeat(centres, 50, axis=0) + 0.05 * rng.standard_normal((2000, DIMS))
    store = make_store(tasks=[dict(id=f"v{i}", title="t", embedding=[float(x) for x in v])
                              for i, v in enumerate(made)])
    queries = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in made[i]]) for i in range(0, 2000, 20)],
        "query_id string, vector array<float>")
    multiplied = []
    real = vector_index.nearest_in_parts

    def counted(items, asked, k, parts, differ=None):
        sizes = items.groupBy("part").count().withColumnRenamed("count", "items")
        pairs = asked.join(sizes, "part").agg(F.sum("items")).first()[0]
        multiplied.append(pairs or 0)
        return real(items, asked, k, parts, differ)

    monkeypatch.setattr(vector_index, "nearest_in_parts", counted)
    got = ids_of(vector_index.search_pruned(store, queries, 10))
    assert got == ids_of(search.search_batch(store, queries, 10))
    assert len(multiplied) == 2 and sum(multiplied) < 2000 * 100 / 8


def test_pruned_search_of_directions_without_structure(spark, make_store, monkeypatch):
    """Cells that all have to be visited are visited in groups: a query is copied no
    more often than on a grid, in batches of bounded size, and the result is exact."""
    rng = np.random.default_rng(6)
    made = rng.standard_normal((1500, DIMS))
    store = make_store(tasks=[dict(id=f"v{i}", title="t", embedding=[float(x) for x in v])
                              for i, v in enumerate(made)])
    queries = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(made)],
        "query_id string, vector array<float>")
    sent = []
    real = vector_index.nearest_in_parts

    def counted(items, asked, k, parts, differ=None):
        sent.append((asked.count(), parts))
        return real(items, asked, k, parts, differ)

    monkeypatch.setattr(vector_index, "nearest_in_parts", counted)
    got = vector_index.search_pruned(store, queries, 10)
    assert sent[-1][0] <= 1500 * sent[-1][1] and sent[-1][1] <= 4 and len(sent) == 2

    def all_of(hits):
        return sorted((r["query_id"], r["rank"], r["id"], round(r["similarity"], 9))
                      for r in hits.collect())

    assert all_of(got) == all_of(search.search_batch(store, queries, 10))


def test_visits_are_cut_to_bounded_batches():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["id"])
    cut = list(vector_index._slices(iter([batch]), 4096))
    assert sum(b.num_rows for b in cut) == 10_000
    assert max(b.num_rows for b in cut) * 4096 <= vector_index.ANGLES


@pytest.mark.parametrize("differ", [None, 120])
def test_parts_keep_the_best_of_all_pairs(differ):
    """Blocks after the first are held against what was found: same rows as all pairs,
    with many equal vectors, zero vectors and an item's own tags."""
    import pyarrow as pa
    rng = np.random.default_rng(7)
    vecs = rng.standard_normal((3000, 16)).astype(np.float32)
    vecs[rng.integers(0, 3000, 900)] = vecs[0]
    vecs[5] = 0
    ids = [f"i{i}" for i in rng.permutation(3000)]
    words = rng.integers(0, 2, (3000, 256)).astype(np.uint64)
    sketch = (words.reshape(3000, 4, 64) << np.arange(64, dtype=np.uint64)).sum(
        axis=2, dtype=np.uint64).view(np.int64)
    part = search._Part(0, differ)
    part.hold(pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(list(vecs), pa.list_(pa.float32())),
         pa.array([["q3"] if i % 2 else None for i in range(3000)], pa.list_(pa.string())),
         pa.array(list(sketch), pa.list_(pa.int64()))], ["id", "embedding", "tags", "sketch"]))
    asked = [f"q{i}" for i in range(60)]
    found = pa.Table.from_batches(part.find(pa.RecordBatch.from_arrays(
        [pa.array(asked), pa.array(list(vecs[:60].astype(float)), pa.list_(pa.float64())),
         pa.array(list(sketch[:60]), pa.list_(pa.int64()))], ["id", "vector", "sketch"]), 7)).to_pylist()
    units = unit_rows(vecs.astype(float))
    scores = np.round(units[:60] @ units.T, 12)
    scores[3, 1::2] = np.nan
    if differ is not None:
        scores[(words[:60, None, :] != words[None, :, :]).sum(axis=2) > differ] = np.nan
    for c, query in enumerate(asked):
        want = sorted((-s, i) for s, i in zip(scores[c], ids) if not np.isnan(s))[:7]
        got = [(r["id"], r["similarity"]) for r in found if r["query_id"] == query]
        assert [i for i, _ in got] == [i for _, i in want]
        assert np.allclose([s for _, s in got], [-s for s, _ in want])
