"""Refinement of texts in batches, by a backend that takes several at once."""

import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterator, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowspark.operators.ingest import REFINED, answers_of, refine_postprocess, text_runs


class BatchRefiner(Protocol):
    """Cleans up several raw texts: per text ``(content, title, tags)`` or an exception
    of its own. Raising fails the call as a whole. Called from several threads."""

    def refine_batch(self, raws: list, content_types: list) -> list: ...


class FirstLineRefiner:
    """Keeps the text, takes its first line as title and its type as tag. Refuses
    whole batches that hold a type it does not know."""

    KNOWN = ("thought", "note", "event")
    TITLE = 60

    def refine_batch(self, raws: list, content_types: list) -> list:
        if not set(content_types) <= set(self.KNOWN):
            raise ValueError("unknown type")
        return [(raw, raw.strip().split("\n")[0][:self.TITLE], [kind])
                for raw, kind in zip(raws, content_types)]


def _answers(backend: BatchRefiner, raws: list, kinds: list, retries: int, wait: float) -> list:
    """One row per text. A call that fails ``retries`` times more is split in two, so
    in the end only the texts that cannot be refined are left without an answer."""
    error = None
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1))
        try:
            found = backend.refine_batch(raws, kinds)
            if len(found) != len(raws):
                raise ValueError(f"{len(found)} answers to {len(raws)} texts")
            return [(None, None, None, f"the refiner failed: {x}") if isinstance(x, Exception)
                    else (x[0], x[1], list(x[2] or []), None) for x in found]
        except Exception as failure:  # any failure of a backend concerns its texts only
            error = failure
    if len(raws) == 1:
        return [(None, None, None, f"the refiner failed: {error}")]
    half = len(raws) // 2
    return _answers(backend, raws[:half], kinds[:half], 0, wait) \
        + _answers(backend, raws[half:], kinds[half:], 0, wait)


def refine_batches(df: DataFrame, make_refiner: Callable[[], BatchRefiner] = FirstLineRefiner,
                   size: int = 32, concurrency: int = 4, retries: int = 2,
                   wait: float = 0.5) -> DataFrame:
    """Sends ``content`` through a backend, ``size`` texts a call, and post-processes.

    A task has up to ``concurrency`` calls under way, so a cluster has that many for
    each of its cores: choose it by what the backend bears. A call that fails is
    tried again after ``wait`` seconds, twice that, and so on; then it is split until
    the failing texts stand alone, which get ``refine_error``. Rows stay in order.
    """
    if size < 1 or concurrency < 1 or retries < 0:
        raise ValueError("size and concurrency must be positive, retries not negative")

    @F.arrow_udf(REFINED)
    def call(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        backend = make_refiner()
        with ThreadPoolExecutor(concurrency) as pool:
            for texts, types in batches:
                for run in text_runs(texts, size * concurrency):
                    raws = texts[run].to_pylist()
                    kinds = ["thought" if kind is None else kind for kind in types[run].to_pylist()]
                    parts = pool.map(
                        lambda i: _answers(backend, raws[i:i + size], kinds[i:i + size], retries, wait),
                        range(0, len(raws), size))
                    yield answers_of([r for part in parts for r in part])

    # Not deterministic: a backend is asked once per row.
    answered = df.withColumn("_r", call.asNondeterministic()("content", "content_type"))
    return refine_postprocess(answered.withColumns({
        "content": F.col("_r.content"), "title": F.col("_r.title"),
        "tags": F.col("_r.tags"), "refine_error": F.col("_r.error")}).drop("_r"))
