"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Features of a text: its words (lower-cased runs of letters, runs of other marks),
pairs of neighbouring words, and triples of word shapes (lower, capital, upper,
digits, the mark itself, same as one of the two words before), hashed to
``2**BITS`` places. A feature's value is the root of its share of all features,
so every text is a vector of length one. Labels, lang, source and doc_id are no
inputs.

Training: at most ``TRAIN_ROWS`` labelled rows (``labelled.sample``) in
``SHARDS`` shards; each shard runs FTRL-proximal over its rows, and the weights
are averaged. The driver gets ``SHARDS`` vectors of ``2**BITS`` floats.

NULL and empty texts have no features: their score is that of the bias. Repeated
rows are scored alike. Without labelled rows every score is 0.5. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowspark.llm import labelled, text as T

BITS = 18
TRAIN_ROWS = 20_000
SHARDS = 4
#: Passes over the rows of a shard, and updates that a small shard gets at least
#: (in no more than ``MOST_EPOCHS`` passes).
EPOCHS, UPDATES, MOST_EPOCHS = 3, 5_000, 20
#: FTRL-proximal: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
#: Score from which a document counts as good.
THRESHOLD = 0.3
SCHEMA = "doc_id long, score double"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a piece: ``(row, place, value)``, sorted by row and place."""
    low = T.lowered(data)
    starts, ends, bounds, letters = T.token_bounds(data, offsets)
    words = T.word_prints(low, starts, ends, 5)
    row = T.rows_of(bounds)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int64)))
    digit = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57), dtype=np.int64)))
    size, up = ends - starts, upper[ends] - upper[starts]
    shape = np.where(up == 0, 1, np.where((up == size) & (size > 1), 3, 2))
    shape = np.where(digit[ends] > digit[starts], 4, shape).astype(T.U64)
    shape = np.where(letters, shape, words)
    for back in (1, 2):
        same = np.zeros(len(words), dtype=bool)
        same[back:] = (words[back:] == words[:-back]) & (row[back:] == row[:-back]) & letters[back:]
        shape[same] = 5
    keys, rows = [words], [row]
    pair = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    keys.append(T.mix(words[:-1] * T.U64(T.BASE_A) + T.mix(words[1:]))[pair])
    rows.append(row[1:][pair])
    triple = row[2:] == row[:-2] if len(row) > 1 else np.zeros(0, bool)
    keys.append(T.mix(shape[:-2] * T.U64(T.BASE_A) + T.mix(shape[1:-1] * T.U64(T.BASE_B)
                      + T.mix(shape[2:] + T.U64(77))))[triple])
    rows.append(row[2:][triple])
    place = np.concatenate(keys) >> T.U64(64 - BITS)
    row = np.concatenate(rows)
    packed = np.sort((row.astype(T.U64) << T.U64(BITS)) | place)
    new = np.ones(len(packed), dtype=bool)
    new[1:] = packed[1:] != packed[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    row = (packed >> T.U64(BITS)).astype(np.int64)
    total = np.bincount(row, weights=count, minlength=len(offsets) - 1)
    return row, (packed & T.U64((1 << BITS) - 1)).astype(np.int64), np.sqrt(count / total[row])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights (bias last) after all passes over ``(places, values, label)``."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(max(EPOCHS, min(MOST_EPOCHS, UPDATES // max(len(rows), 1)))):
        for places, values, label in rows:
            at = np.append(places, 1 << BITS)
            x = np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from ``quality`` of at most ``rows`` labelled documents."""
    examples = labelled.sample(documents, labels, "quality", rows) \
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text", "label"], kind="stable")
        pdf = pdf.sample(frac=1.0, random_state=7)  # a fixed order, mixed
        rows, labels = [], pdf["label"].to_numpy()
        for first, end, data, offsets in T.pieces(pa.array(pdf["text"], pa.large_string())):
            row, place, value = features(data, offsets)
            cuts = np.searchsorted(row, np.arange(end - first + 1))
            rows += [(place[a:b], value[a:b], int(y))
                     for a, b, y in zip(cuts[:-1], cuts[1:], labels[first:end])]
        w = ftrl(rows)
        return pd.DataFrame({"n": [len(rows)], "w": [w.astype(np.float32).tobytes()]})

    fitted = examples.groupBy("shard").applyInPandas(fit, "n long, w binary").collect()
    total = np.zeros((1 << BITS) + 1)
    for r in fitted:
        total += r.n * np.frombuffer(r.w, dtype=np.float32)
    return total / max(sum(r.n for r in fitted), 1)


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """Every document's score: the logistic of a sparse dot product."""
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in T.pieces(batch["text"]):
                row, place, value = features(data, offsets)
                dot = np.bincount(row, weights=value * weights[place], minlength=end - first)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, end - first),
                     pa.array(1 / (1 + np.exp(-np.clip(dot + weights[-1], -35, 35))))],
                    names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents outside the held-out fold, score all."""
    return score(documents, train(documents, labels)).select(
        "doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
