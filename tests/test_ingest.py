"""Validation, defaults, embedding, refinement, entry sources."""

import json

import numpy as np
import pyarrow as pa
import pytest
from backends import Batches, Shouter, WrongDimensions
from pyspark.sql import functions as F

from knowspark import schema
from knowspark.operators import ingest, refining
from knowspark.sources import notes as sources
from knowspark.sources.notes import read_entries_json, read_text_notes

ENTRY = schema.ENTRIES


def entries(spark, *rows):
    return spark.createDataFrame(
        [tuple({**dict.fromkeys(ENTRY.names), **r}[n] for n in ENTRY.names) for r in rows], ENTRY)


def reasons(df, key):
    return {r[key]: list(r["reject_reasons"]) for r in df.collect()}


def test_validate_entries(spark):
    df = entries(
        spark, {"entry_id": "ok", "content": "x" * 50_000, "content_type": "note"},
        {"entry_id": "default", "content": "x"},
        {"entry_id": "long", "content": "x" * 50_001}, {"entry_id": "empty", "content": ""},
        {"entry_id": "null"}, {"entry_id": "type", "content": "x", "content_type": "task"})
    assert reasons(ingest.check(df, "entries"), "entry_id") == {
        "ok": [], "default": [], "long": ["content is too long"], "empty": ["content is empty"],
        "null": ["content is missing"], "type": ["content_type is not allowed"]}
    ok, rejected = ingest.validate(df, "entries")
    assert {r[0] for r in ok.select("entry_id").collect()} == {"ok", "default"}
    assert rejected.count() == 4
    assert ok.columns == df.columns


def test_validate_updates_allow_null(spark):
    df = spark.createDataFrame(
        [("a", None, "done"), ("b", "", None), ("c", "x", "closed")],
        "id string, title string, status string")
    assert reasons(ingest.check(df, "tasks", update=True), "id") == {
        "a": [], "b": ["title is empty"], "c": ["status is not allowed"]}


@pytest.mark.parametrize("kind,column,limit", [
    ("contacts", "name", 200), ("home_items", "name", 300), ("interactions", "note", 5000)])
def test_length_limits(spark, kind, column, limit):
    df = spark.createDataFrame(
        [("fits", "x" * limit), ("not", "x" * (limit + 1)), ("none", None)],
        f"id string, {column} string")
    got = reasons(ingest.check(df, kind), "id")
    assert got["fits"] == [] and len(got["not"]) == 1 and len(got["none"]) == 1


def test_absent_optional_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "")], "id string, title string")
    assert reasons(ingest.check(df, "tasks"), "id") == {"a": [], "b": ["title is empty"]}
    assert ingest.check(df, "tasks").columns == ["id", "title", "reject_reasons"]


def test_required_column(spark):
    with pytest.raises(ValueError):
        ingest.check(spark.range(1), "contacts")


def test_apply_defaults(spark):
    row = ingest.apply_defaults(entries(spark, {"entry_id": "a", "content": "x"}), "thoughts").first()
    assert (row["source"], row["content_type"], row["tags"], row["metadata"]) == (
        "api", "thought", [], "{}")


def test_ingest_rows(spark):
    note = "\n\n".join(c * 60 for c in "abc")
    df = entries(
        spark, {"entry_id": "n", "content": note, "content_type": "note", "title": "T",
                "tags": ["t"], "metadata": '{"k": 1}'}, {"entry_id": "t", "content": "hi"})
    rows = ingest.ingest(df, "2024-01-01", lambda: ingest.HashEmbedder(8)).collect()
    chunked = sorted((r for r in rows if r["entry_id"] == "n"), key=lambda r: r["chunk_index"])
    assert [r["content"] for r in chunked] == [c * 60 for c in "abc"]
    assert chunked[0]["parent_id"] is None
    assert {r["parent_id"] for r in chunked[1:]} == {chunked[0]["id"]}
    assert {(r["title"], tuple(r["tags"]), r["metadata"]) for r in chunked} == {
        ("T", ("t",), '{"k": 1}')}
    assert len({r["id"] for r in rows}) == 4
    assert all(len(r["embedding"]) == 8 for r in rows)
    again = {r["id"] for r in ingest.ingest(df.repartition(3), "2024-02-01").collect()}
    assert again == {r["id"] for r in rows}


def test_ingest_summary(spark):
    df = entries(spark, {"entry_id": "n", "content": "\n\n".join(c * 60 for c in "abc"),
                         "content_type": "note"}, {"entry_id": "t", "content": "hi"})
    assert {(r[0], r[2]) for r in ingest.ingest_summary(df).collect()} == {("n", 3), ("t", 1)}
    assert tuple(ingest.ingest_totals(df).first()) == (2, 4)


def test_embedding_of_null_and_similar_texts(spark):
    df = spark.createDataFrame(
        [("a", "the cat sat"), ("b", "The CAT sat down"), ("c", "stock prices fell"), ("d", None),
         ("e", " ")], "id string, content string")
    got = {r["id"]: r["embedding"] for r in ingest.embed(df, "content").collect()}
    assert got["d"] is None and got["e"] == [0.0] * 384
    assert len(got["a"]) == 384
    near, far = np.dot(got["a"], got["b"]), np.dot(got["a"], got["c"])
    assert near > far
    assert abs(np.dot(got["a"], got["a"]) - 1) < 1e-6


def test_embedding_dimensions_are_checked(spark):
    df = spark.createDataFrame([("x",)], "content string")
    with pytest.raises(Exception, match="3 dimensions"):
        ingest.embed(df, "content", WrongDimensions).collect()


@pytest.mark.parametrize("size, concurrency", [(1, 1), (3, 2), (100, 4)])
def test_refine_in_batches(spark, size, concurrency):
    """A failing text costs its own row only, whatever batch it is in."""
    texts = ["fine", "boom", "flaky", "refuse", "short", "  ", "last"] + [f"t{i}" for i in range(20)]
    df = spark.createDataFrame([(t, t, None if i % 2 else "note") for i, t in enumerate(texts)],
                               "entry_id string, content string, content_type string").coalesce(1)
    rows = refining.refine_batches(df, Batches, size, concurrency, retries=2, wait=0.001).collect()
    assert [r["entry_id"] for r in rows] == texts
    got = {r["entry_id"]: r for r in rows}
    assert got["boom"]["refine_error"] == "the refiner failed: offline"
    assert got["boom"]["content"] is None and got["boom"]["tags"] == []
    assert got["refuse"]["refine_error"] == "the refiner failed: refused"
    assert got["  "]["refine_error"] == "the refiner gave no content"
    for t in ("fine", "short", "last", "t19"):
        assert got[t]["refine_error"] is None and got[t]["content"] == t.upper()
        assert got[t]["tags"] == ["work"]
    assert got["fine"]["title"] == "note" and got["t0"]["title"] == "thought"
    if size == 1:
        assert got["flaky"]["refine_error"] is None  # came through on the third call


def test_calls_of_a_task_are_bounded():
    """Never more calls under way than asked for."""
    import threading
    import time

    class Slow:
        now = most = 0
        lock = threading.Lock()

        def refine_batch(self, raws, kinds):
            with self.lock:
                Slow.now += 1
                Slow.most = max(Slow.most, Slow.now)
            time.sleep(0.01)
            with self.lock:
                Slow.now -= 1
            return [(r, None, []) for r in raws]

    from concurrent.futures import ThreadPoolExecutor
    backend = Slow()
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: refining._answers(backend, ["x"], ["note"], 0, 0), range(30)))
    assert 1 < Slow.most <= 3


def test_refine(spark):
    df = entries(spark, *[{"entry_id": k, "content": k} for k in ("fine", "boom", "blank")])
    got = {r["entry_id"]: r for r in ingest.refine(df, Shouter).collect()}
    assert got["fine"]["content"] == "FINE" and got["fine"]["title"] is None
    assert got["fine"]["tags"] == ["work", "ideas", "t0", "t1", "t2"]
    assert got["fine"]["refine_error"] is None
    assert got["boom"]["refine_error"] == "the refiner failed: offline"
    assert got["blank"]["refine_error"] == "the refiner gave no content"


def test_text_notes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text(" first line\nsecond\n\n", encoding="utf-8")
    (tmp_path / "deep" / "b.txt").write_text("other", encoding="utf-8")
    (tmp_path / "skip.md").write_text("no", encoding="utf-8")
    (tmp_path / "empty.txt").write_text(" \n", encoding="utf-8")
    rows = read_text_notes(spark, str(tmp_path)).collect()
    assert {r["content"] for r in rows} == {"first line\nsecond", "other"}
    assert {r["content_type"] for r in rows} == {"note"}
    assert len({r["entry_id"] for r in rows}) == 2


def test_entries_json(spark, tmp_path):
    lines = [json.dumps({"content": "same"})] * 2 + [
        json.dumps({"entry_id": "e", "content": "x", "content_type": "event", "tags": ["a"],
                    "metadata": {"k": [1]}}), "{broken"]
    (tmp_path / "in.json").write_text("\n".join(lines), encoding="utf-8")
    df = read_entries_json(spark, str(tmp_path / "in.json"))
    ok, rejected = ingest.validate(df, "entries")
    rows = {r["entry_id"]: r for r in ok.collect()}
    assert len(rows) == 3 and json.loads(rows["e"]["metadata"]) == {"k": [1]}
    bad = rejected.collect()
    assert len(bad) == 1 and bad[0]["_corrupt_record"] == "{broken"
    assert "not valid JSON" in bad[0]["reject_reasons"]
    assert ingest.ingest(ok, "2024-01-01").filter(F.col("id").isNull()).count() == 0


def test_equal_nameless_lines_are_numbered_by_count(spark, tmp_path, monkeypatch):
    """A line that is a third of a file: ids of its own, dealt over tasks, and the
    same ids however the file is split."""
    monkeypatch.setattr(sources, "NUMBERED", 50)
    same = json.dumps({"content": "again", "content_type": "note"})
    lines = [same if i % 3 == 0 else json.dumps({"content": f"c{i}", "content_type": "note"})
             for i in range(3000)]
    (tmp_path / "in.json").write_text("\n".join(lines))

    def ids():
        rows = read_entries_json(spark, str(tmp_path / "in.json"))
        return rows, sorted((r["content"], r["entry_id"]) for r in rows.collect())

    rows, whole = ids()
    assert len(whole) == len(set(whole)) == 3000
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    tasks = rows.filter("content = 'again'").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set(merge, "true")
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 1000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    assert ids()[1] == whole
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_texts_are_refined_in_runs_of_bounded_size():
    """All rows in order, whatever the size of the Arrow batch; whole calls but the last."""
    texts = pa.array([None if i % 7 == 0 else "x" * 50_000 for i in range(500)])
    for least in (1, 32, 128, 1000):
        runs = list(ingest.text_runs(texts, least))
        assert [r.start for r in runs] == [0] + [r.stop for r in runs[:-1]] and runs[-1].stop == 500
        assert all((r.stop - r.start) % least == 0 for r in runs[:-1])
        most = max((r.stop - r.start) for r in runs) * 50_000
        assert most <= 1.5 * ingest.REFINED_BYTES + least * 50_000
    assert list(ingest.text_runs(texts[:0])) == []


@pytest.mark.parametrize("refine", [ingest.refine, refining.refine_batches])
def test_refining_passes_answers_on_in_runs(spark, refine):
    """Answers of 30 MB of text come in one Arrow batch each way: rows stay with theirs."""
    df = spark.range(300, numPartitions=1).selectExpr(
        "id", "concat(id, repeat('y', 100000)) AS content", "'note' AS content_type")
    got = refine(df).selectExpr("id", "content = concat(id, repeat('y', 100000)) AS same", "refine_error")
    assert got.filter("same AND refine_error IS NULL").count() == 300
