"""Merkle manifest of a table, by butterfly exchange.

Leaf of a row: SHA-256 (lowercase hex) of its fields. Per source, leaves ascend by
doc_id (NULL first, equal ids by leaf); as long as several nodes remain, every
``FANOUT`` neighbours (the last run fewer, even one) become the digest of their
digests. What remains is the source's root; these roots, ordered by source (NULL
first), make the upper tree in the same way.

1. Leaves are numbered by a distributed rank. ``FANOUT ** HEIGHT`` neighbours of a
   source are one *part*: aligned, so a part is a whole subtree.
2. Each part hashes its own subtree.
3. Butterfly: in round r, the parts of one node meet those of its sibling nodes in
   lanes of at most ``FANOUT`` parts, one from each sibling. All members of a lane
   swap their nodes' roots, and each hashes the common parent for itself. So after
   the last round each part has the root and the siblings on its way up; nothing is
   handed down. A node with fewer parts than its siblings serves several lanes.
   The rounds of the sources' trees come first, those of the upper tree follow on.
4. Each part joins what it has gathered with the siblings inside its subtree.

A lane is a window of at most ``FANOUT`` rows and a part has 4,096 leaves at most, so
no source, however large, meets in a task. Rounds grow with the logarithm of the parts.

Repeated rows are leaves of their own. NULL fields and empty texts have different
leaves. Texts of any length are hashed where they are read; only digests travel.
Extra columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from knowspark.llm.scratch import written
from knowspark.operators.ranks import numbered

FANOUT = 16
#: Levels of a part's own subtree: 4,096 leaves.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(**fields) -> Column:
    """Digest of the named fields: ``-`` for NULL, else byte count, colon, value."""
    parts = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def subtree(leaves: list, alone: bool, height: int) -> list:
    """Levels of a part's tree, leaves first: ``height`` above them, or, if the part
    is all of its source, as many as are needed to come to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= height:
        below = levels[-1]
        levels.append([digest("".join(below[i:i + FANOUT]))
                       for i in range(0, len(below), FANOUT)])
    return levels


def _siblings(levels: list, upper: list) -> list:
    """Of each leaf: per level what stands before and after it, joined as text."""
    runs = [["".join(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)]
            for level in levels[:-1]]
    out = []
    for i in range(len(levels[0])):
        steps = []
        for run in runs:
            i, k = divmod(i, FANOUT)
            steps.append(f"{run[i][:64 * k]},{run[i][64 * (k + 1):]}")
        out.append(";".join(steps + upper))
    return out


def _swap(parts: DataFrame, tree: Column, index: str, width: Column, level: int) -> DataFrame:
    """One round: nodes of this level swap their digests and become their parent.

    ``parts(q, sid, part, parts, subroot, digest, proof)``; the node of a part is
    (``tree``, ``index`` div FANOUT**level), and ``width`` the number of the tree's first
    nodes. Parts whose tree has one node left stay as they are.
    """
    below = FANOUT ** level
    node, group = F.expr(f"{index} div {below}L"), F.expr(f"{index} div {below * FANOUT}L")
    here = parts.filter(width > below).withColumns({"t0": tree, "node0": node, "g0": group})
    # The parts of a node are neighbours in q. Few rows: one for each node.
    nodes = here.groupBy(F.col("t0").alias("t"), F.col("node0").alias("node"),
                         F.col("g0").alias("g")).agg(
        F.min("q").alias("low"), F.count(F.lit(1)).alias("members"))
    lanes = nodes.groupBy(F.col("t").alias("t2"), F.col("g").alias("g2")).agg(
        F.max("members").alias("lanes"))
    nodes = nodes.join(lanes, (F.col("t") == F.col("t2")) & (F.col("g") == F.col("g2"))) \
        .select("t", "node", "low", "members", "lanes")
    here = here.join(nodes, (F.col("t0") == F.col("t")) & (F.col("node0") == F.col("node")))
    place = F.col("q") - F.col("low")
    sent = here.withColumn("lane", F.explode(F.sequence(
        place, F.col("lanes") - 1, F.col("members"))))
    meeting = Window.partitionBy("t0", "g0", "lane")
    met = sent.withColumn("run", F.array_sort(F.collect_list(
        F.struct("node0", "digest")).over(meeting))).filter(F.col("lane") == place)

    def text(keep):
        return F.array_join(F.transform(F.filter("run", keep), lambda x: x["digest"]), "")

    step = F.concat(text(lambda x: x["node0"] < F.col("node0")), F.lit(","),
                    text(lambda x: x["node0"] > F.col("node0")))
    climbed = met.select(
        "q", "sid", "part", "parts", "subroot", F.sha2(text(lambda x: F.lit(True)), 256).alias("digest"),
        F.concat("proof", F.array(step)).alias("proof"))
    return written(climbed.unionByName(parts.filter(width <= below)), "merkle-round")


def _rounds(parts: DataFrame, tree: Column, index: str, width: Column, most: int) -> DataFrame:
    level = 0
    while most > FANOUT ** level:
        parts = _swap(parts, tree, index, width, level)
        level += 1
    return parts


def manifest(documents: DataFrame, also: dict[str, Column] | None = None,
             height: int = HEIGHT) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof`` of every row, and the digests ``also``
    names, which are made of the row and take no part in the tree.

    ``proof``: levels from the leaf up, ``;`` between them, each as the digests
    before and those after, ``,`` between. :func:`folded` goes up along it.
    """
    also = also or {}
    leaves = written(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        leaf_of().alias("leaf"), *(c.alias(k) for k, c in also.items())), "merkle-leaves")
    rows = numbered(leaves, F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), "leaf")
    sources = numbered(rows.groupBy("source").agg(
        F.min("position").alias("start"), F.count(F.lit(1)).alias("n")), "start", out="sid")
    rows = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))) \
        .withColumn("i", F.col("position") - F.col("start")) \
        .withColumn("part", F.expr(f"i div {FANOUT ** height}L")) \
        .withColumn("doc_id", F.col("doc_id").cast("string")) \
        .select("sid", "part", "i", "n", "doc_id", "leaf", *also)
    extra = list(also)

    def part_root(own: pd.DataFrame) -> pd.DataFrame:
        first, leaves = own.iloc[0], own.sort_values("i")["leaf"].tolist()
        levels = subtree(leaves, len(leaves) == first["n"], height)
        return pd.DataFrame({"sid": [first["sid"]], "part": [first["part"]],
                             "parts": [-(-first["n"] // FANOUT ** height)], "digest": levels[-1]})

    roots = rows.select("sid", "part", "i", "n", "leaf").groupBy("sid", "part") \
        .applyInPandas(part_root, "sid long, part long, parts long, digest string")
    parts = numbered(roots, "sid", "part", out="q").select(
        "q", "sid", "part", "parts", F.lit(None).cast("string").alias("subroot"), "digest",
        F.array().cast("array<string>").alias("proof"))
    most, last = parts.agg(F.coalesce(F.max("parts"), F.lit(0)), F.coalesce(F.max("sid"), F.lit(0))) \
        .first()
    parts = _rounds(parts, F.col("sid"), "part", F.col("parts"), most)
    parts = _rounds(parts.withColumn("subroot", F.col("digest")), F.lit(0), "sid", F.lit(last + 1),
                    last + 1)
    ways = parts.select("sid", "part", "subroot", F.col("digest").alias("root"),
                        F.array_join("proof", ";").alias("proof"))

    def prove(own: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        up = way.iloc[0]
        levels = subtree(own["leaf"].tolist(), len(own) == own["n"].iloc[0], height)
        return pd.DataFrame({
            "doc_id": own["doc_id"], "leaf": own["leaf"], **{k: own[k] for k in extra},
            "subroot": up["subroot"], "root": up["root"],
            "proof": _siblings(levels, up["proof"].split(";") if up["proof"] else [])})

    columns = ["doc_id", "leaf", *extra, "subroot", "root", "proof"]
    return rows.groupBy("sid", "part").cogroup(ways.groupBy("sid", "part")).applyInPandas(
        prove, ", ".join(f"{c} string" for c in columns)) \
        .withColumn("doc_id", F.col("doc_id").cast("long"))


def folded(leaf, proof="proof") -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(
        F.filter(F.split(proof, ";"), lambda s: s != ""), F.col(leaf) if isinstance(leaf, str)
        else leaf, lambda node, step: F.sha2(F.concat(
            F.substring_index(step, ",", 1), node, F.substring_index(step, ",", -1)), 256))


def proof_digest(proof="proof") -> Column:
    """Digest of all siblings along a proof, from left to right."""
    return F.sha2(F.translate(proof, ",;", ""), 256)


def verify(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest, checked against rows of which some were tampered with.

    Tampering lower-cases A-Z of the text where 5 divides the CRC-32 of the doc_id.
    ``folded_root`` leads from the tampered leaf, else the original one, through the
    original siblings; ``verified`` says whether it is the root.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0
    found = manifest(documents, {"now": F.when(hit, leaf_of(text=lower))}, height)
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"),
        folded(F.coalesce("now", "leaf")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
