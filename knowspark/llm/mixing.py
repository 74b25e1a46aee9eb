"""Mixing sources to target weights by soft membership, in DataFrame operations only.

1. A classifier learnt from the labels table gives every document the posteriors
   of the domains (good and low by default): naive Bayes over the shapes of words
   (letters of one case and digits alike; a word that repeats the one before is a
   shape of its own) hashed to ``BUCKETS`` places, counted over at most
   ``TRAIN_ROWS`` labelled documents; a text's evidence is its sum over
   informative places, tempered by their number.
2. Rates. A document of ``n`` tokens and posteriors ``p`` counts ``rate * n * p``
   towards the domains. Projected-gradient least squares starts at rate 1 and
   minimises the weighted squared distance between the domains' expected totals
   and their targets. In the metric of the tokens a document's gradient is ``p .
   residual``; summed up over the steps it is one number per domain, and the
   rates are its projection, ``max(0, 1 - p . sum)``. So a step is one sum over
   the corpus, combined before the shuffle, and the driver holds the residuals.
   With residuals divided by the domains' own totals a step of 1 always converges.
3. Copies. A rate becomes whole copies by rounding at a point drawn from the
   document's id, so a rerun draws the same; the expected number is the rate. Rates
   meet the targets within ``TOLERANCE``, copies only on average: few large documents
   in a domain can leave its drawn total some per cent off.

A domain without tokens keeps its residual and moves nothing; a warning is given
where ``STEPS`` do not come within the tolerance. NULL and empty texts have no tokens
and the posteriors of the prior; texts of any length are read as a whole. Equal rows get equal rates
and copies. Without labelled rows all domains are equally likely. An empty table
gives an empty result. Columns of the documents are kept as they are.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, functions as F

from knowspark.llm.scratch import fresh, written

BUCKETS = 1 << 14
TRAIN_ROWS = 20_000
#: Least count and log ratio of an informative place.
MIN_COUNT, MIN_RATIO = 20, 1.0
#: Weight of the evidence against the prior.
SHARPNESS = 2.0
STEPS = 100
#: Largest residual, as a share of all tokens, that ends the steps.
TOLERANCE = 1e-4
DOMAINS = {"good": "quality = 1", "low": "quality = 0"}
#: Shares of all tokens.
TARGETS = {"good": 0.95, "low": 0.05}
BLANK = r"[\x20\x09-\x0D]+"
#: Lower letters, upper letters and digits up to U+017F, each read as one sign.
_LETTERS = [c for c in map(chr, range(0x30, 0x180)) if c.isalnum()]
_SIGNS = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in _LETTERS]
SAME = "=="


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def _shapes(text: Column) -> Column:
    """The shape of every word, in order."""
    return F.aggregate(
        F.array(_words(text)), F.array().cast("array<string>"),
        lambda _, words: F.transform(words, lambda w, i: F.when(
            w == F.get(words, i - 1), F.lit(SAME)).otherwise(
                F.translate(w, "".join(_LETTERS), "".join(_SIGNS)))))


def _place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _numbers(values: list) -> Column:
    """A constant array, folded once."""
    return F.split(F.lit(",".join(f"{v:.4g}" for v in values)), ",").cast("array<double>")


def train(documents: DataFrame, labels: DataFrame, domains: dict = DOMAINS) -> dict:
    """Per domain, the log prior and the log ratio of each place against all words.

    At most ``BUCKETS`` rows for each domain reach the driver.
    """
    names = list(domains)
    domain = F.coalesce(*[F.when(F.expr(rule), F.lit(k)) for k, rule in enumerate(domains.values())])
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))
        .filter("doc_id IS NOT NULL AND domain IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(TRAIN_ROWS))
    # At most TRAIN_ROWS pairs of numbers: bounded whatever the corpus.
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .join(F.broadcast(chosen), "doc_id")
    counts = (
        sample.select("domain", F.explode(_shapes(F.col("text"))).alias("word"))
        .groupBy("domain", _place(F.col("word")).alias("place"))
        .agg(F.count(F.lit(1)).alias("n")).collect())
    rows = {r.domain: r.n for r in chosen.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
            .collect()}
    table = [[0] * BUCKETS for _ in names]
    for r in counts:
        table[r.domain][r.place] = r.n
    every = [sum(t[b] for t in table) for b in range(BUCKETS)]
    total = sum(every) + BUCKETS
    model = {}
    for k, name in enumerate(names):
        own = sum(table[k]) + BUCKETS
        ratios = []
        for b in range(BUCKETS):
            ratio = math.log((table[k][b] + 1) / own) - math.log((every[b] + 1) / total)
            ratios.append(ratio if every[b] >= MIN_COUNT else 0.0)
        model[name] = (math.log((rows.get(k, 0) + 1) / (sum(rows.values()) + len(names))), ratios)
    for b in range(BUCKETS):  # places that tell nothing
        if max(abs(m[1][b]) for m in model.values()) < MIN_RATIO:
            for m in model.values():
                m[1][b] = 0.0
    return model


def posteriors(documents: DataFrame, model: dict, tokens: str = "n_tokens",
               members: str = "membership") -> DataFrame:
    """The documents with their tokens and an array of domain posteriors."""
    telling = _numbers([float(any(m[1][b] for m in model.values())) for b in range(BUCKETS)])
    start = F.array(*[F.lit(0.0)] * (len(model) + 1))
    weights = [telling, *[_numbers(m[1]) for m in model.values()]]
    places = F.filter(F.transform(_shapes(F.col("text")), _place),
                      lambda p: F.get(telling, p) > 0)

    def weight(table):
        return lambda total, p: total + F.get(table, p)

    sums = F.aggregate(F.array(places), start, lambda _, ps: F.array(*[
        F.aggregate(ps, F.lit(0.0), weight(w)) for w in weights]))
    soft = F.aggregate(F.array(sums), F.array().cast("array<double>"), lambda _, s: F.array(*[
        F.lit(m[0]) + SHARPNESS * s[k + 1] / F.sqrt(1 + s[0]) for k, m in enumerate(model.values())]))
    soft = F.aggregate(F.array(soft), F.array().cast("array<double>"), lambda _, s: F.transform(
        s, lambda x: F.exp(x - F.array_max(s))))
    soft = F.aggregate(F.array(soft), F.array().cast("array<double>"), lambda _, s: F.transform(
        s, lambda x: x / F.aggregate(s, F.lit(0.0), lambda a, b: a + b)))
    return documents.withColumn(tokens, F.size(_words(F.col("text"))).cast("long")) \
        .withColumn(members, soft)


def _rate(members: str, pull: list[float]) -> Column:
    fall = sum((F.col(members)[k] * float(c) for k, c in enumerate(pull)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - fall)


def solve(measured: DataFrame, targets: list[float], budget: float | None = None,
          tokens: str = "n_tokens", members: str = "membership") -> tuple[list[float], list]:
    """The summed gradient, one number per domain, and the totals of each step.

    ``targets`` are shares; they are brought to ``budget`` tokens in all (as many
    as there are, if not given).
    """
    k = range(len(targets))
    share = [F.col(tokens) * F.col(members)[i] for i in k]

    def totals(rate):
        row = measured.agg(*[F.coalesce(F.sum(rate * s), F.lit(0.0)).alias(f"t{i}")
                             for i, s in enumerate(share)]).first()
        return [float(v) for v in row]

    own = totals(F.lit(1.0))
    budget = sum(own) if budget is None else budget
    goal = [t / sum(targets) * budget for t in targets]
    pull, seen = [0.0 for _ in k], [own]
    for _ in range(STEPS):
        now = seen[-1]
        if max((abs(now[i] - goal[i]) for i in k if own[i] > 0), default=0) \
                <= TOLERANCE * max(budget, 1):
            break
        pull = [pull[i] + ((now[i] - goal[i]) / own[i] if own[i] > 0 else 0.0) for i in k]
        seen.append(totals(_rate(members, pull)))
    else:
        warnings.warn(f"targets not met after {STEPS} steps: {seen[-1]} for {goal}", stacklevel=2)
    return pull, seen


def rates(documents: DataFrame, labels: DataFrame, targets: dict = TARGETS,
          domains: dict = DOMAINS) -> DataFrame:
    """``doc_id``, tokens, posteriors, rate and copies of every document."""
    model = train(documents, labels, domains)
    measured = written(
        posteriors(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
        .drop("text"), "mixing-posteriors")
    pull, _ = solve(measured, [targets[d] for d in domains])
    rated = measured.withColumn("rate", _rate("membership", pull))
    return rated.select(
        "doc_id", "n_tokens",
        *[F.col("membership")[k].alias(f"p_{d}") for k, d in enumerate(domains)],
        "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def _copies(rate: Column, key: Column) -> Column:
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + draw).cast("int")


def mix(documents: DataFrame, labels: DataFrame, targets: dict = TARGETS,
        domains: dict = DOMAINS) -> DataFrame:
    """The documents, each as often as its rate says; columns unchanged."""
    tokens, members = fresh(documents.columns, "n_tokens", "membership")
    model = train(documents, labels, domains)
    # Posteriors are dear: they are written once, with the rows.
    measured = written(posteriors(documents, model, tokens, members), "mixing-posteriors")
    pull, _ = solve(measured, [targets[d] for d in domains], None, tokens, members)
    copies = _copies(_rate(members, pull), F.col("doc_id").cast("long"))
    return measured.withColumn(tokens, F.explode(F.when(
        copies > 0, F.array_repeat(F.lit(True), copies)))).select(*documents.columns)
