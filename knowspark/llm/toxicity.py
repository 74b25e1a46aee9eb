"""Toxicity: a linear-chain conditional random field tags toxic words; the
marginals of forward-backward add up to document scores and offending offsets.

1. Labelled tokens. Labels are per document, so words and word parts that occur
   almost only in toxic documents are looked up first (a count over the sample,
   combined before the shuffle); their tokens in toxic documents are labelled 1,
   all other tokens 0.
2. The field. Two states; a token's evidence is a sum of hashed weights of the
   word, its first 4 and 5 and its last 3 bytes; chains are ``CHAIN`` tokens long
   at most. ``SHARDS`` shards fit it by mini-batches, the parameters are averaged.
3. Scores. With two states forward and backward messages are single odds, so a
   step of the recursion is one vector operation over all chains of a piece. The
   expected number of toxic words and the largest marginal go through a logistic
   curve fitted on the sample.

Everything learnt comes from at most ``TRAIN_ROWS`` labelled rows outside the
held-out fold. Labels, lang, source and doc_id are no inputs of a score.

NULL, empty and wordless texts have no tokens and get the score of none. Repeated
rows are scored alike. Without toxic labels every score is 0. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from knowspark.llm import labelled, text as T
from knowspark.llm.scratch import fresh

BITS = 20
CHAIN = 64
TRAIN_ROWS = 20_000
SHARDS = 4
#: Passes over the chains of a shard, and batches that a small shard gets at least
#: (in no more than ``MOST_EPOCHS`` passes).
EPOCHS, STEPS, MOST_EPOCHS = 6, 150, 40
BATCH = 256
RATE = 0.3
L2 = 1e-4
#: A feature marks toxic tokens from so many toxic documents, such a share of them
#: (copies of one toxic document share all their words) and such odds on.
MIN_DOCUMENTS, MIN_SHARE, MIN_ODDS = 4, 0.015, 20.0
#: Most features that may mark tokens.
LEXICON = 50_000
#: Features that a task counts by itself at a time.
ROUND_KEYS = 1_000_000
#: One in so many chains without a toxic token is trained on.
THIN = 8
THRESHOLD = 0.5
SCHEMA = "doc_id long, score double, spans array<struct<start:int,end:int>>"
#: Parameters after the feature weights: the start and the four transitions.
EXTRA = 5


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Letter runs of a piece: starts, ends, first of each text, feature places
    ``(tokens, 4)``."""
    low = T.lowered(data)
    starts, ends, bounds, letters = T.token_bounds(low, offsets)
    bounds = np.concatenate(([0], np.cumsum(letters)))[bounds]
    starts, ends = starts[letters], ends[letters]
    places = np.empty((len(starts), 4), dtype=np.int64)
    cuts = [(starts, ends), (starts, np.minimum(starts + 4, ends)),
            (starts, np.minimum(starts + 5, ends)), (np.maximum(ends - 3, starts), ends)]
    for k, (a, b) in enumerate(cuts):
        h = T.word_prints(low, a, b, 31 + k) if k < 3 else _ends_print(low, a, b)
        places[:, k] = h >> T.U64(64 - BITS)
    return starts, ends, bounds, places


def _ends_print(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of at most three bytes each."""
    out = (b - a).astype(T.U64) + T.U64(0x5851F42D4C957F2D)
    table = T.byte_table(37)
    for k in range(3):
        inside = a + k < b
        out[inside] = T.mix(out[inside] * T.U64(T.BASE_A) + table[low[(a + k)[inside]]])
    return T.mix(out)


def chains(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of all chains."""
    sizes = np.diff(bounds)
    parts = -(-sizes // CHAIN)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(bounds[:-1], parts) + place * CHAIN
    return first, np.minimum(np.repeat(bounds[1:], parts) - first, CHAIN)


def _grid(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers by (step, chain), and which are real."""
    steps = np.arange(int(size.max()) if len(size) else 0)[:, None]
    real = steps < size
    return np.where(real, first + steps, first), real


def messages(evidence: np.ndarray, real: np.ndarray, params: np.ndarray):
    """Odds of state 1: forward and backward, by (step, chain)."""
    start, (t00, t01, t10, t11) = np.exp(params[0]), np.exp(params[1:])
    odds = np.exp(np.clip(evidence, -30, 30))
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    if len(odds):
        forward[0] = start * odds[0]
    for t in range(1, len(odds)):
        forward[t] = odds[t] * (t01 + t11 * forward[t - 1]) / (t00 + t10 * forward[t - 1])
    for t in range(len(odds) - 2, -1, -1):
        ahead = odds[t + 1] * backward[t + 1]
        backward[t] = np.where(real[t + 1], (t10 + t11 * ahead) / (t00 + t01 * ahead), 1.0)
    return odds, forward, backward


def marginals(places: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The chance of being toxic, token by token."""
    out = np.zeros(len(places))
    first, size = chains(bounds)
    if len(first):
        grid, real = _grid(first, size)
        evidence = weights[:-EXTRA][places].sum(axis=1)[grid]
        _, forward, backward = messages(evidence, real, weights[-EXTRA:])
        both = forward * backward
        out[grid[real]] = (both / (1 + both))[real]
    return out


def fit(places: np.ndarray, marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Weights and transitions by Adagrad on the conditional likelihood."""
    w = np.zeros((1 << BITS) + EXTRA)
    w[-EXTRA] = -3.0
    seen = np.full(len(w), 1e-6)
    first, size = chains(bounds)
    rng = np.random.default_rng(3)
    batches = -(-len(first) // BATCH)
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, STEPS // max(batches, 1)))):
        order = rng.permutation(len(first))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            grid, real = _grid(first[pick], size[pick])
            at_places = places[grid]
            y = marked[grid]
            params = w[-EXTRA:]
            odds, forward, backward = messages(w[:-EXTRA][at_places].sum(axis=2), real, params)
            both = forward * backward
            p = both / (1 + both)
            grad = np.zeros(len(w))
            miss = (y - p)[real]
            grad[:-EXTRA] = np.bincount(at_places[real].ravel(), weights=np.repeat(miss, 4),
                                        minlength=1 << BITS)
            grad[-EXTRA] = (y[0] - p[0]).sum()
            moves = np.exp(params[1:])
            if len(odds) > 1:
                ahead, behind, here = (odds * backward)[1:], forward[:-1], real[1:]
                joint = np.stack([np.broadcast_to(moves[0], ahead.shape), moves[1] * ahead,
                                  moves[2] * behind, moves[3] * behind * ahead])
                joint /= joint.sum(axis=0)
                was, now = y[:-1], y[1:]
                true = np.stack([(1 - was) * (1 - now), (1 - was) * now, was * (1 - now), was * now])
                grad[-EXTRA + 1:] = ((true - joint) * here).sum(axis=(1, 2))
            grad = grad / len(pick) - L2 * w
            seen += grad * grad
            w += RATE * grad / np.sqrt(seen)
            w[-EXTRA:] = np.clip(w[-EXTRA:], -8, 8)
    return w


def _lexicon(sample: DataFrame) -> np.ndarray:
    """Features found almost only in toxic documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(keys, toxic):
            keys, toxic = np.concatenate(keys), np.concatenate(toxic)
            found, place = np.unique(keys, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(np.bincount(place, weights=toxic).astype(np.int64)),
                 pa.array(np.bincount(place).astype(np.int64))], names=["f", "toxic", "n"])

        for batch in batches:
            label = batch["label"].to_numpy()
            keys, toxic = [], []
            for first, end, data, offsets in T.pieces(batch["text"]):
                starts, _, bounds, places = tokens(data, offsets)
                row = T.rows_of(bounds)
                packed = np.unique((row[:, None] << (BITS + 2) | places << 2
                                    | np.arange(4)).ravel())
                keys.append(packed & ((1 << (BITS + 2)) - 1))
                toxic.append(label[first + (packed >> (BITS + 2))])
                if sum(map(len, keys)) >= ROUND_KEYS:
                    yield counted(keys, toxic)
                    keys, toxic = [], []
            if keys:
                yield counted(keys, toxic)

    totals = sample.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    clean = max(totals.n - (totals.toxic or 0), 1)
    least = max(MIN_DOCUMENTS, MIN_SHARE * (totals.toxic or 0))
    share = (F.col("toxic") + 0.1) / max(totals.toxic or 0, 1) \
        / ((F.col("n") - F.col("toxic") + 0.1) / clean)
    rows = (
        sample.select("text", "label").mapInArrow(run, "f long, toxic long, n long")
        .groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
        .filter((F.col("toxic") >= least) & (share >= MIN_ODDS))
        .orderBy(F.col("toxic").desc(), "f").limit(LEXICON).collect())
    return np.sort(np.array([r.f for r in rows], dtype=np.int64))


def _marked(places: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Tokens with a feature of the lexicon; the last bytes alone are no mark."""
    keys = places[:, :3] << 2 | np.arange(3)
    return np.isin(keys, lexicon).any(axis=1) if len(keys) else np.zeros(0, bool)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """Field weights and the document curve, from at most ``rows`` labelled rows."""
    sample = labelled.sample(documents, labels, "toxic", rows)
    lexicon = _lexicon(sample)

    def fit_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text", "label"], kind="stable")
        label, parts, n = pdf["label"].to_numpy(), [], 0
        for first, _, data, offsets in T.pieces(pa.array(pdf["text"], pa.large_string())):
            _, _, bounds, places = tokens(data, offsets)
            mark = _marked(places, lexicon) & (label[first + T.rows_of(bounds)] == 1)
            begin, size = chains(bounds)
            sums = np.concatenate(([0], np.cumsum(mark)))
            take = (sums[begin + size] > sums[begin]) | (np.arange(n, n + len(begin)) % THIN == 0)
            n += len(begin)
            begin, size = begin[take], size[take]
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            parts.append((places[at], mark[at].astype(float), size))
        places, mark, size = (np.concatenate(p) for p in zip(*parts))
        w = fit(places, mark, np.concatenate(([0], np.cumsum(size))))
        return pd.DataFrame({"n": [len(size)], "w": [w.astype(np.float32).tobytes()]})

    fitted = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int")) \
        .groupBy("shard").applyInPandas(fit_shard, "n long, w binary").collect()
    weights = np.zeros((1 << BITS) + EXTRA)
    for r in fitted:
        weights += r.n * np.frombuffer(r.w, dtype=np.float32)
    weights /= max(sum(r.n for r in fitted), 1)
    found = _evidence(sample.select("doc_id", "text", "label"), weights) \
        .select("label", "expected", "most").collect()  # at most ``rows`` rows of three numbers
    return weights, _curve(found)


def _inputs(expected, most) -> np.ndarray:
    return np.stack([np.log(np.asarray(expected) + 1e-3), np.asarray(most),
                     np.ones(np.shape(expected))], axis=-1)


def _curve(rows) -> np.ndarray:
    """Logistic regression on two numbers, by Newton steps."""
    if not any(r.label for r in rows):
        return np.array([0.0, 0.0, -50.0])
    x = _inputs([r.expected for r in rows], [r.most for r in rows])
    y = np.array([r.label for r in rows], dtype=float)
    c = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(curve, x.T @ (y - p) - 0.1 * c)
        c += step
        if np.abs(step).max() < 1e-6:
            break
    return c


def _evidence(documents: DataFrame, weights: np.ndarray, keep_text: bool = False,
              names: tuple = ("expected", "most", "spans")) -> DataFrame:
    """Per document: expected toxic words, the largest marginal, and the spans of
    words more likely toxic than not, in code points."""
    weights = weights.astype(np.float32)
    kept = [f for f in documents.schema if keep_text or f.name != "text"]
    others = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for first, end, data, offsets in T.pieces(batch["text"]):
                starts, ends, bounds, places = tokens(data, offsets)
                m = marginals(places, bounds, weights)
                row, n = T.rows_of(bounds), end - first
                most = np.zeros(n)
                np.maximum.at(most, row, m)
                bad = np.flatnonzero(m > 0.5)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
                base = chars[offsets[:-1]][row[bad]]
                spans = pa.StructArray.from_arrays(
                    [pa.array((chars[x[bad]] - base).astype(np.int32)) for x in (starts, ends)],
                    fields=list(span))
                cuts = np.searchsorted(row[bad], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(first, n) for c in others),
                     pa.array(np.bincount(row, weights=m, minlength=n), pa.float64()), pa.array(most),
                     pa.ListArray.from_arrays(pa.array(cuts), spans)],
                    names=[*others, *names])

    span = StructType().add("start", "integer").add("end", "integer")
    schema = StructType(list(kept)).add(names[0], "double").add(names[1], "double") \
        .add(names[2], ArrayType(span))
    return documents.mapInArrow(run, schema)


def _logistic(expected: Column, most: Column, curve: np.ndarray) -> Column:
    raw = (F.log(expected + 1e-3) * float(curve[0]) + most * float(curve[1]) + float(curve[2]))
    return 1 / (1 + F.exp(-F.least(F.greatest(raw, F.lit(-35.0)), F.lit(35.0))))


def clean(documents: DataFrame, model) -> DataFrame:
    """The documents that score below the threshold, all columns as they are."""
    weights, curve = model
    names = fresh(documents.columns, "expected", "most", "spans")
    seen = _evidence(documents, weights, True, names)
    return seen.filter(_logistic(F.col(names[0]), F.col(names[1]), curve) < THRESHOLD) \
        .select(*documents.columns)


def score(documents: DataFrame, model) -> DataFrame:
    """Every document's score with the offsets of the words behind it."""
    weights, curve = model
    seen = _evidence(documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                                      F.col("text").cast("string").alias("text")), weights)
    return seen.select("doc_id", _logistic(F.col("expected"), F.col("most"), curve).alias("score"),
                       "spans")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents outside the held-out fold, score all."""
    return score(documents, train(documents, labels)).select(
        "doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"), "spans")
