"""Near duplicates by a chosen-path set similarity join.

Sets: the distinct five-word shingles of a text (A-Z lowered); fewer words make
one shingle of all. Documents with equal sets are one class; only classes are
joined. Two classes are linked if ``100 * shared >= 75 * union``, confirmed on
the full sets.

Chosen paths: each class has ``COORDINATES`` minwise tokens, and each tree has
coordinates of its own among them: one, or two in every third tree. A class begins
in the nodes that its tokens there name. A deeper node is named by its path; the name
gives one or two hash functions that no other node has, and each class goes on to the
child that its least shingle under them names. Similar sets meet again and again,
others part.

* A node of up to ``SMALL`` classes is compared exhaustively, in two passes: first each
  class's best partner by signature is confirmed as a pair; then, where classes of
  a node may still join two components, their full sets meet in the node, one matrix
  product gives all intersections, and only what connects them is passed on.
* A larger node compares all its classes with ``PIVOTS`` of them, then branches on,
  unless all its classes are already connected: links inside a component would
  not change any result, so a huge group of near copies ends in a few levels
  instead of giving all its pairs.
* A pair at similarity 0.75 shares each child of a node it shares with chance 0.75.
  Deeper nodes have 1.525 children of a class on average, so 1.14 shared ones: above
  one, paths do not die out with depth. The chance that a shared node has no shared
  descendant at some depth is at most 0.513, so one of the 21 first-level nodes fails
  for good with 0.25 + 0.75 * 0.513 = 0.635, and all of them with 0.635 ** 21 =
  0.00007: recall is above 0.9999 at every level. Strangers just below the limit
  also stay together longer; at 0.74 a level holds 1.13 times the memberships of the
  one before. Pairs that agree in fewer than ``LEAST`` of 64 coordinates (more than
  4.5 standard deviations below) are not confirmed.

Confirming is spent on what can change a component; pairs are rows only in the
first pass, one for each class and node.

Result per document: size of its set, component (its smallest doc_id), and whether
it is that document. NULL, empty and wordless texts are linked with nothing. Equal
rows are linked. A NULL doc_id counts as the smallest. Rows that share a doc_id
are judged by their own texts. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from knowspark.llm import text as T
from knowspark.llm.components import components
from knowspark.llm.repeats import NULL_ID, binaries, contents, identified, steps
from knowspark.llm.scratch import forget_shuffles, fresh, written

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 75
COORDINATES = 64
#: Agreeing coordinates from which a pair is confirmed on its sets.
LEAST = 32
TREES = 16
SMALL = 2048
#: Shingles of a node that are compared in one matrix product.
COLUMNS = 4096
PIVOTS = 3
#: Levels after which what is left of a node is compared in blocks, whole.
LEVELS = 40
#: Of forty nodes below the first level so many choose one hash function, the others two.
ONE_OF_FORTY = 19
#: Shingles that a task hashes at a time on the way to the next level.
AT_A_TIME = 1 << 21


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and their bounds."""
    low = T.lowered(data)
    starts, ends, words = T.word_bounds(low, offsets)
    prefix = T.Prefix(T.word_prints(low, starts, ends, 3), T.BASE_A)
    sizes = np.diff(words)
    count = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), count)
    first = words[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    prints = prefix.of(first, np.minimum(first + SHINGLE, words[1:][row]))
    order = np.lexsort((prints, row))
    prints, row = prints[order], row[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])
    return prints[new], np.searchsorted(row[new], np.arange(len(sizes) + 1))


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    a, b = bounds[:-1], bounds[1:]
    return (T.signed(T.Prefix(values, T.BASE_A).of(a, b)),
            T.signed(T.Prefix(T.mix(values + T.U64(9)), T.BASE_B).of(a, b)))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The least value of each set under each of ``COORDINATES`` hash functions."""
    out = np.zeros((len(bounds) - 1, COORDINATES), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        seeds = T.mix(np.arange(1, COORDINATES + 1, dtype=T.U64) * T.U64(T.BASE_A)) | T.U64(1)
        for k in range(COORDINATES):
            least = np.minimum.reduceat(values * seeds[k], bounds[:-1][full])
            out[full, k] = least >> T.U64(32)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in T.pieces(batch["text"]):
                values, bounds = shingles(data, offsets)
                k1, k2 = set_keys(values, bounds)
                sig = signatures(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(first, end - first) for c in ("doc_id", "d", "t")), pa.array(k1), pa.array(k2), pa.array(np.diff(bounds)),
                     binaries(sig.view(np.uint8).reshape(-1),
                              np.full(end - first, COORDINATES * 4))],
                    names=["doc_id", "d", "t", "k1", "k2", "n", "sig"])

    return docs.mapInArrow(run, "doc_id long, d long, t long, k1 long, k2 long, n long, sig binary")


def _sig_rows(column: pa.Array) -> np.ndarray:
    return contents(column)[0].view(np.uint32).reshape(-1, COORDINATES)


def _roots(sig: np.ndarray, trees: int) -> Iterator[np.ndarray]:
    """Names of the first-level nodes of each signature. Trees share no coordinate."""
    own = max(COORDINATES // trees, 1)
    for tree in range(trees):
        for turn in range(2 if tree % 3 == 2 else 1):
            at = (tree * own + turn) % COORDINATES
            root = T.mix(np.full(1, tree * 2 + turn + 1, dtype=T.U64) * T.U64(0x9FB21C651E98DF25))
            yield T.mix(root + sig[:, at].astype(T.U64) * T.U64(T.BASE_A))


def _least(values: np.ndarray, bounds: np.ndarray, row: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The least value of set ``row[i]`` under the hash function of ``seed[i]``."""
    size = np.diff(bounds)[row]
    reach = np.concatenate(([0], np.cumsum(size)))
    out, start = np.zeros(len(row), dtype=T.U64), 0
    while start < len(row):
        stop = max(int(np.searchsorted(reach, reach[start] + AT_A_TIME, "right")) - 1, start + 1)
        some = size[start:stop]
        at = np.repeat(bounds[row[start:stop]], some) + steps(some)
        out[start:stop] = np.minimum.reduceat(
            values[at] * np.repeat(seed[start:stop], some), reach[start:stop] - reach[start])
        start = stop
    return out >> T.U64(32)


def _children(node: np.ndarray, row: np.ndarray, values: np.ndarray, bounds: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the children that each (node, set ``row``) goes on to."""
    choice = T.mix(node ^ T.U64(0x8BB84B93962EACC9))
    places, names = [], []
    for turn in range(2):
        goes = np.ones(len(node), bool) if not turn \
            else choice % T.U64(40) >= T.U64(ONE_OF_FORTY)
        place = np.flatnonzero(goes)
        own = T.mix(choice[place] + T.U64(turn + 1) * T.U64(T.BASE_B & (1 << 62) - 1))
        least = _least(values, bounds, row[place], own | T.U64(1))
        places.append(place)
        names.append(T.mix(own + least * T.U64(T.BASE_A)))
    return np.concatenate(places), np.concatenate(names)


def _first_level(classes: DataFrame, trees: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _sig_rows(batch["sig"])
            for node in _roots(sig, trees):
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(node)), batch["c"]],
                                                 names=["node", "c"])

    return classes.select("c", "sig").mapInArrow(run, "node long, c long")


def _next_level(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of open nodes go on by their full sets, a class once with all its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch["nodes"].offsets.to_numpy()
            node = batch["nodes"].values.to_numpy()[ends[0]:ends[-1]].view(T.U64)
            row = T.rows_of(ends)
            data, bounds = contents(batch["items"])
            place, child = _children(
                node, row, np.frombuffer(data.tobytes(), dtype=T.U64), bounds // 8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.signed(child)), pa.array(batch["c"].to_numpy()[row[place]])],
                names=["node", "c"])

    return members.groupBy("c").agg(F.collect_list("node").alias("nodes")) \
        .join(sets.select("c", "items"), "c").select("c", "nodes", "items") \
        .mapInArrow(run, "node long, c long")


def _sketch(sig: np.ndarray) -> np.ndarray:
    return (sig & np.uint32(0xFF)).astype(np.uint8)


def _sketches(classes: DataFrame) -> DataFrame:
    """A byte of each coordinate: what nodes carry to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = _sketch(_sig_rows(batch["sig"]))
            yield pa.RecordBatch.from_arrays(
                [batch["c"], batch["n"], binaries(
                    sketch.reshape(-1), np.full(len(sketch), COORDINATES))],
                names=["c", "n", "sketch"])

    return classes.select("c", "n", "sig").mapInArrow(run, "c long, n long, sketch binary")


def _sizes_allow(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n_a, n_b) >= SIMILAR * np.maximum(n_a, n_b)


def _nodes_at_a_time(batches, act) -> Iterator[pa.RecordBatch]:
    """Apply ``act`` to whole nodes over batches sorted by node."""
    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        node = batch["node"].to_numpy()
        cut = len(node) - int(np.argmax(np.append(node[::-1] != node[-1], True)))
        if cut:
            yield from act(batch.slice(0, cut))
        held = batch.slice(cut)
    if held is not None and held.num_rows:
        yield from act(held)


def _near_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``a > b`` of one node that may be similar and are not connected, with
    their agreeing coordinates; about a hundred thousand comparisons at a time."""
    node, c, n, comp = (batch[x].to_numpy() for x in ("node", "c", "n", "comp"))
    sketch = contents(batch["sketch"])[0].reshape(-1, COORDINATES)
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    opens = np.repeat(starts, np.diff(np.append(starts, len(node))))
    before = np.arange(len(node)) - opens  # partners of each row
    reach = np.concatenate(([0], np.cumsum(before)))
    row = 0
    while row < len(node):
        stop = max(int(np.searchsorted(reach, reach[row] + 100_000, "right")) - 1, row + 1)
        count = before[row:stop]
        a = np.repeat(np.arange(row, stop), count)
        b = opens[a] + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        fit = (comp[a] != comp[b]) & (c[a] != c[b]) & _sizes_allow(n[a], n[b])
        a, b = a[fit], b[fit]
        same = (sketch[a] == sketch[b]).sum(axis=1)
        near = same >= LEAST
        yield a[near], b[near], same[near]
        row = stop


def _best_pairs(sketched: DataFrame) -> DataFrame:
    """Of each class of a small node its best partner, as pairs."""

    def pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = batch["c"].to_numpy()
        most, partner = np.zeros((2, batch.num_rows), dtype=np.int64)
        for a, b, same in _near_pairs(batch):
            for one, other in ((a, b), (b, a)):
                order = np.lexsort((other, -same, one))
                order = order[np.append(True, one[order][1:] != one[order][:-1])[:len(order)]]
                order = order[same[order] > most[one[order]]]
                most[one[order]], partner[one[order]] = same[order], other[order]
        row = np.flatnonzero(most)
        one, other = c[row], c[partner[row]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other)),
             pa.array(most[row].astype(np.int32))], names=["a", "b", "same"])

    return sketched.repartition("node").sortWithinPartitions("node", "c") \
        .mapInArrow(lambda b: _nodes_at_a_time(b, pairs), "a long, b long, same int")


def _unsettled(sketched: DataFrame) -> DataFrame:
    """Members of small nodes that may be similar to one they are not connected to."""

    def members(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left = np.zeros(batch.num_rows, dtype=bool)
        for a, b, _ in _near_pairs(batch):
            left[a] = left[b] = True
        yield batch.select(["node", "c", "comp"]).filter(pa.array(left))

    return sketched.repartition("node").sortWithinPartitions("node", "c") \
        .mapInArrow(lambda b: _nodes_at_a_time(b, members), "node long, c long, comp long")


def connected(sets: list[np.ndarray]) -> np.ndarray:
    """For each of some full sets the first one it is connected to by similar ones."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = times[codes] > 1
    row, codes = np.repeat(np.arange(n), sizes)[shared], codes[shared]
    codes = (np.cumsum(times > 1) - 1)[codes]
    order = np.argsort(codes, kind="stable")
    row, codes = row[order], codes[order]
    both = np.zeros((n, n), dtype=np.int32)
    for start in range(0, int(codes[-1]) + 1 if len(codes) else 0, COLUMNS):
        here = slice(*np.searchsorted(codes, (start, start + COLUMNS)))
        holds = np.zeros((n, COLUMNS), dtype=np.float32)
        holds[row[here], codes[here] - start] = 1
        both += (holds @ holds.T).astype(np.int32)  # at most COLUMNS each: exact
    linked = both * np.int64(100) >= SIMILAR * (sizes[:, None] + sizes[None, :] - both)
    label = np.arange(n)
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _met(unsettled: DataFrame, sets: DataFrame) -> DataFrame:
    """Unsettled members meet with their full sets: links that join components."""

    def links(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, c, comp = (batch[x].to_numpy() for x in ("node", "c", "comp"))
        data, ends = contents(batch["items"])
        items, ends = np.frombuffer(data.tobytes(), dtype=T.U64), ends // 8
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        for first, end in zip(starts, np.append(starts[1:], len(node))):
            label = connected([items[ends[i]:ends[i + 1]] for i in range(first, end)])
            own, joins = c[first:end], comp[first:end]
            other = np.flatnonzero(joins != joins[label])
            if len(other):
                x, y = own[other], own[label[other]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return unsettled.join(sets.select("c", "items"), "c").select("node", "c", "comp", "items") \
        .repartition("node").sortWithinPartitions("node", "c") \
        .mapInArrow(lambda b: _nodes_at_a_time(b, links), "a long, b long")


def _with_pivots(large: DataFrame, sketches: DataFrame, comps: DataFrame) -> DataFrame:
    """Candidate pairs of each class of a large node with the node's pivots."""
    picks = [F.min(F.struct(F.xxhash64("c", "node", F.lit(k)).alias("h"), "c"))["c"]
             for k in range(PIVOTS)]
    pivots = written(large.groupBy("node").agg(F.array_distinct(F.array(*picks)).alias("p"))
                     .select("node", F.explode("p").alias("p")), "near-pivots")
    pairs = large.join(pivots, "node").filter("c <> p").select(
        F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct()
    return _alike(_cross(pairs, comps), sketches)


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (contents(batch[k])[0].reshape(-1, COORDINATES) for k in ("sa", "sb"))
            same = (x == y).sum(axis=1).astype(np.int32)
            keep = (same >= LEAST) & _sizes_allow(batch["na"].to_numpy(), batch["nb"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(batch[k].to_numpy()[keep]) for k in ("a", "b")), pa.array(same[keep])],
                names=["a", "b", "same"])

    side = lambda k: sketches.select(
        F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b") \
        .select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, same int")


def _cross(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs that join two components."""
    own = lambda k: comps.select(F.col("c").alias(k), F.col("comp").alias(f"comp_{k}"))
    return pairs.join(own("a"), "a", "left").join(own("b"), "b", "left") \
        .filter("coalesce(comp_a, a) <> coalesce(comp_b, b)").drop("comp_a", "comp_b")


def _sets(docs: DataFrame, classes: DataFrame, needed: DataFrame) -> DataFrame:
    """``c, n, items``: the full sets of the needed classes. Texts are known by id and
    fingerprint, so very many texts under one id, or none, do not meet each other."""
    wanted = classes.join(needed, "c", "left_semi").select("c", "d", "t", "k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in T.pieces(batch["text"]):
                values, bounds = shingles(data, offsets)
                k1, k2 = set_keys(values, bounds)
                here = batch.slice(first, end - first)
                mine = (here["k1"].to_numpy() == k1) & (here["k2"].to_numpy() == k2)
                items = binaries(values.view(np.uint8), np.diff(bounds) * 8)
                yield pa.RecordBatch.from_arrays(
                    [here["c"], pa.array(np.diff(bounds)), items],
                    names=["c", "n", "items"]).filter(pa.array(mine))

    return docs.select("d", "t", "text").join(wanted, ["d", "t"]).select("c", "k1", "k2", "text") \
        .mapInArrow(run, "c long, n long, items binary").dropDuplicates(["c"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch["xa"], batch["xb"])):
                x, y = (np.frombuffer(v.as_buffer(), dtype=T.U64) for v in (x, y))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum())
                keep[i] = 100 * shared >= SIMILAR * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch[k].to_numpy()[keep]) for k in ("a", "b")], names=["a", "b"])

    side = lambda k: sets.select(F.col("c").alias(k), F.col("items").alias(f"x{k}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b") \
        .select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Nodes that no level could split: all pairs of their blocks as small nodes."""
    blocks = F.ceil(F.col("size") * 2 / SMALL)
    own = F.pmod(F.xxhash64("c"), blocks)
    return members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))) \
        .select(F.xxhash64("node", F.least(own, F.col("other")), F.greatest(own, F.col("other")))
                .alias("node"), "c")


class _Links:
    """The components that the links confirmed so far make."""

    def __init__(self, spark):
        self.comps = spark.createDataFrame([], "c long, comp long")

    def add(self, found: DataFrame) -> None:
        """Links become links between components, so each is looked at once."""
        own = lambda k: self.comps.select(F.col("c").alias(k), F.col("comp").alias(f"comp_{k}"))
        joins = written(
            found.join(own("a"), "a", "left").join(own("b"), "b", "left").select(
                F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
            .filter("a <> b").distinct(), "near-links")
        if joins.isEmpty():
            return
        merged = components(joins)
        # A component is named by one of its classes, so what is new names itself.
        old = self.comps.join(merged.select(F.col("c").alias("was"), F.col("comp").alias("now")),
                              F.col("comp") == F.col("was"), "left") \
            .select("c", F.coalesce("now", "comp").alias("comp"))
        self.comps = written(old.unionByName(merged.join(self.comps.select("c"), "c", "left_anti")),
                             "near-labels")


def near_duplicates(documents: DataFrame, trees: int = TREES) -> DataFrame:
    """Every document with its set size, component and whether it is kept."""
    spark = documents.sparkSession
    docs = identified(documents)
    signed = written(_signed(docs).withColumn("i", F.monotonically_increasing_id()), "near-signed")
    groups = written(signed.filter("n > 0").groupBy("k1", "k2").agg(
        F.min("i").alias("c"), F.min("d").alias("low")), "near-groups")
    classes = written(signed.join(groups.select(F.col("c").alias("i")), "i")
                      .select(F.col("i").alias("c"), "d", "t", "k1", "k2", "n", "sig"), "near-classes")
    sketches = written(_sketches(classes), "near-sketches")
    state, sets = _Links(spark), None
    level, members = 1, written(_first_level(classes, trees), "near-nodes")
    while True:
        sized = written(members.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
                        .filter("size > 1"), "near-sizes")
        members = written(members.join(sized, "node"), "near-members")
        large = members.filter(F.col("size") > SMALL)
        crowded = not sized.filter(F.col("size") > SMALL).isEmpty()
        small = members.filter(F.col("size") <= SMALL)

        def sketched():
            return small.join(sketches, "c").join(state.comps, "c", "left") \
                .select("node", "c", "n", F.coalesce("comp", "c").alias("comp"), "sketch")

        pairs = _best_pairs(sketched())
        if crowded:
            pairs = pairs.unionByName(_with_pivots(large, sketches, state.comps))
        pairs = written(pairs.select("a", "b").distinct(), "near-pairs")
        if sets is None:
            # Whatever may have a partner has a best one; later levels hold large nodes only.
            needed = pairs.select(F.col("a").alias("c")).unionByName(
                pairs.select(F.col("b").alias("c"))).unionByName(large.select("c")).distinct()
            forget_shuffles(spark)
            sets = written(_sets(docs, classes, needed), "near-sets")
        forget_shuffles(spark)
        state.add(_confirmed(pairs, sets))
        unsettled = written(_unsettled(sketched()), "near-unsettled")
        if not unsettled.isEmpty():
            state.add(_met(unsettled, sets))
        if not crowded:
            break
        open_nodes = large.join(state.comps, "c", "left").groupBy("node").agg(
            F.min(F.coalesce("comp", "c")).alias("low"), F.max(F.coalesce("comp", "c")).alias("high")) \
            .filter("low <> high").select("node")
        members = written(large.join(open_nodes, "node"), "near-open")
        if members.isEmpty():
            break
        level += 1
        members = written(
            _next_level(members, sets) if level <= LEVELS else _in_blocks(members),
            "near-nodes").distinct()
    forget_shuffles(spark)
    labelled = groups.join(state.comps, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    lows = labelled.groupBy("comp").agg(F.min("low").alias("component"))
    labelled = written(labelled.join(lows, "comp").select(
        F.col("k1").alias("g1"), F.col("k2").alias("g2"), "component"), "near-components")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("d"))
    return signed.join(labelled, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left") \
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(component != NULL_ID, component).alias("component_id"),
                (F.col("d") == component).alias("kept"))


def one_of_each(documents: DataFrame, trees: int = TREES) -> DataFrame:
    """One document of each component, all columns as they are.

    Of rows equal in doc_id and text one stays. Rows that share a doc_id but not
    the text stand or fall together.
    """
    key, = fresh(documents.columns, "d")
    kept = near_duplicates(documents, trees).filter("kept").select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias(key)).distinct()
    return documents.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))) \
        .join(kept, key).dropDuplicates([key, "text"]).select(*documents.columns)
