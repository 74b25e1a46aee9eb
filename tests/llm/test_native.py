"""Mixing, adaptive rules and shards: results, and plans without Python."""

import re
from collections import Counter, defaultdict
from zlib import crc32

import brute
import pytest
from knowspark.llm import mixing, quality_rules, sharding


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_python(df):
    return not re.search(r"Python|Pandas|ArrowEval|MapInArrow", plan(df))


# Shards

def test_shards_of_odd_documents(docs_of, odd_docs):
    got = sharding.shard_bytes(docs_of(odd_docs), 4)
    assert no_python(got)
    rows = got.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in odd_docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_balanced_and_hot_ranges_cut(docs_of):
    rows = [(i, "one text " * 20) for i in range(2000)] + [(i, "x" * (i % 500)) for i in range(4000)]
    rows += [(7, "the very same row")] * 500
    got = sharding.shard_bytes(docs_of(rows), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(abs(s - mean) for s in sizes.values()) <= 1000
    assert len(got) == len(rows)


def test_shards_of_few_or_no_rows(docs_of):
    one = docs_of([(1, "a")])
    assert [(r.shard, r.slot) for r in sharding.shard_bytes(one, 16).collect()] == [(8, 0)]
    assert sharding.shard_bytes(one.filter("doc_id = 2"), 16).collect() == []


# Quality rules

def test_base_numbers_against_brute_force(docs_of, odd_docs):
    rows = odd_docs + [(70, "# $a <b>\n\n# $a <b>\nx\n x\nx\r"), (71, "q " * 19), (72, "p q r s " * 30)]
    got = quality_rules.apply_rules(docs_of(rows))
    assert no_python(got)
    want = []
    for i, text in rows:
        w, t = brute.words(text), text or ""
        seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
                     len(lines) - len(set(lines)), len(covered),
                     len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept").collect()
    assert brute.rows([r[:-1] for r in rows]) == brute.rows(want)
    assert not any(r.kept and r.base_failed for r in rows)


def test_thresholds_follow_language_and_source(spark):
    """A source that is full of symbols by nature keeps them; elsewhere they fail."""
    def doc(i, source, symbols):
        return i, " ".join(f"w{i}x{k}" + "#" * symbols for k in range(40)), "en", source
    rows = [doc(i, "code", 3) for i in range(300)] + [doc(300 + i, "prose", 0) for i in range(300)]
    rows += [doc(600, "prose", 3), doc(601, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs).collect()}
    assert all(kept[i] for i in range(600)) and not kept[600] and kept[601]


def kept_of(spark, groups):
    """``groups``: per source the numbers of plain and of junk documents; the ids of
    the kept ones, by source and kind."""
    rows = []
    for source, (plain, junk) in groups.items():
        for i in range(plain + junk):
            marks = "##|" if i >= plain else ""
            rows.append((len(rows), " ".join(f"w{i}x{k}{marks}" for k in range(40)), "en", source,
                         i >= plain))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    verdicts = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs.drop("junk")).collect()}
    out = Counter()
    for i, _, _, source, junk in rows:
        out[source, junk] += verdicts[i]
    return out


@pytest.mark.parametrize("share", [0.1, 0.2])
def test_junk_does_not_raise_its_own_limit(spark, share):
    n = int(400 * share)
    kept = kept_of(spark, {"a": (400 - n, n), "b": (100, 0)})
    assert kept["a", True] == 0 and kept["a", False] == 400 - n and kept["b", False] == 100


def test_no_group_size_switches_the_rule(spark):
    """Groups of 20, 199 and 200 documents with an eighth of junk lose it alike."""
    for n in (20, 199, 200):
        kept = kept_of(spark, {"a": (n - n // 8, n // 8), "b": (300, 0)})
        assert kept["a", True] == 0 and kept["a", False] == n - n // 8


def test_limits_blend_by_size(spark):
    """One document more moves a limit by little, and none is above the highest."""
    rows = [("en", "a", 5 * i, 100, 0, 0, 50) for i in range(40)] + [("en", "b", 0, 100, 0, 0, 50)] * 60
    names = "lang string, source string, n_symbols long, word_chars long, n_dup_lines long, " \
            "n_repeat_words long, n_words long"
    limit = lambda rows: {r.source: r.symbol_rate for r in quality_rules.thresholds(
        spark.createDataFrame(rows, names)).collect()}
    one, more = limit(rows), limit(rows + rows[:1])
    assert 0.05 <= one["b"] < one["a"] <= quality_rules.HIGHEST
    assert abs(one["a"] - more["a"]) < 0.02


def test_rules_of_an_empty_table(docs_of):
    assert quality_rules.apply_rules(docs_of([(1, "a")]).filter("doc_id = 2")).collect() == []


# Mixing

def labelled(spark, docs_of, n=400):
    good = [(i, " ".join(f"word{(i * 7 + k) % 90}x" for k in range(30))) for i in range(n)]
    low = [(n + i, " ".join(f"w{k}||##" for k in range(30))) for i in range(n // 2)]
    labels = [(i, 1, 0) for i in range(0, n, 2)] + [(n + i, 0, 0) for i in range(0, n // 2, 2)]
    labels += [(None, 1, 0), (3, None, None)]
    return good + low, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rates_meet_the_targets(spark, docs_of):
    rows, labels = labelled(spark, docs_of)
    rows = rows + [(None, None), (5000, ""), rows[0]]
    got = mixing.rates(docs_of(rows), labels, {"good": 0.9, "low": 0.1})
    assert no_python(got)
    found = got.collect()
    assert len(found) == len(rows) and all(r.rate >= 0 and r.copies >= 0 for r in found)
    total = sum(r.n_tokens for r in found)
    for name, share in (("good", 0.9), ("low", 0.1)):
        tokens = sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in found)
        assert abs(tokens - share * total) < 0.01 * total
    assert all((r.p_good > 0.5) == (r.doc_id < 400) for r in found if r.n_tokens)


def test_projection_stops_at_zero(spark):
    """Soft members of an unwanted domain cannot get negative rates."""
    rows = [(10, [0.9, 0.1])] * 50 + [(10, [0.2, 0.8])] * 50 + [(10, [0.0, 1.0])] * 50
    measured = spark.createDataFrame(rows, "n_tokens long, membership array<double>")
    pull, seen = mixing.solve(measured, [1.0, 0.0], 400.0)
    rates = measured.select(mixing._rate("membership", pull)).collect()
    assert min(r[0] for r in rates) >= 0
    error = lambda t: (t[0] - 400) ** 2 + t[1] ** 2
    assert error(seen[-1]) < error(seen[0])


def test_drawn_copies_come_near_the_targets(spark, docs_of):
    rows, labels = labelled(spark, docs_of, 1000)
    got = mixing.mix(docs_of(rows), labels, {"good": 0.9, "low": 0.1}).collect()
    tokens = [(r.doc_id >= 1000, len(r.text.split())) for r in got]
    low = sum(n for is_low, n in tokens if is_low) / sum(n for _, n in tokens)
    assert abs(low - 0.1) < 0.02


def test_targets_out_of_reach_are_told(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    measured = spark.createDataFrame([(10, [0.9, 0.1])] * 50 + [(10, [0.2, 0.8])] * 50,
                                     "n_tokens long, membership array<double>")
    with pytest.warns(UserWarning, match="targets not met"):
        mixing.solve(measured, [1.0, 0.0], 700.0)


def test_mix_keeps_columns(spark, docs_of):
    rows, labels = labelled(spark, docs_of)
    docs = docs_of(rows).withColumnRenamed("key", "n_tokens").withColumnRenamed("name", "membership")
    mixed = mixing.mix(docs, labels, {"good": 0.99, "low": 0.01})
    assert mixed.columns == docs.columns and no_python(mixed)
    count = Counter(r.doc_id for r in mixed.collect())
    assert all(count[i] >= 1 for i in range(400)) and sum(count[400 + i] for i in range(200)) < 40


@pytest.mark.parametrize("empty", ["documents", "labels"])
def test_mixing_without_rows(spark, docs_of, empty):
    rows, labels = labelled(spark, docs_of, 20)
    docs = docs_of(rows)
    if empty == "documents":
        assert mixing.rates(docs.filter("doc_id < 0"), labels).collect() == []
    else:
        got = mixing.rates(docs, labels.filter("doc_id < 0")).collect()
        assert len(got) == len(rows) and all(abs(r.p_good - 0.5) < 1e-9 for r in got)
