"""Connected components of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from knowspark.llm.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``c, comp`` for every end of a link ``(a, b)``: the smallest number reachable.

    Links are contracted round by round. Each vertex points to its smallest
    neighbour if that is smaller than itself, pointers jump once over another, and
    every link is moved to where its ends point; loops and repeats drop out, so the
    links that the next round joins are fewer. Pointers stay inside a component and
    its smallest vertex points to itself, so when no link is left all others lead
    there; the pointers of all rounds are then put together from the last one back.
    All tables are written, and a vertex with very many links costs a row per task
    after the combining step; joins are left to skew splitting.
    """
    ends = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    links = written(links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v").distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.select(F.explode(F.array(ends("u", "v"), ends("v", "u"))).alias("l"))
        points = both.groupBy(F.col("l.u").alias("c")).agg(F.min("l.v").alias("v")) \
            .select("c", F.least("c", "v").alias("to"))
        points = written(points, "points")
        further = points.select(F.col("c").alias("at"), F.col("to").alias("further"))
        points = written(points.join(further, F.col("to") == F.col("at")).select(
            "c", F.col("further").alias("to")), "points")
        rounds.append(points)
        links = written(
            _moved(_moved(links, points, "u"), points, "v").filter("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if not rounds:
        return links.select(F.col("u").alias("c"), F.col("v").alias("comp"))
    roots = rounds.pop().withColumnRenamed("to", "comp")
    while rounds:
        later = roots.select(F.col("c").alias("at"), "comp")
        roots = written(rounds.pop().join(later, F.col("to") == F.col("at"), "left").select(
            "c", F.coalesce("comp", "to").alias("comp")), "labels")
    return roots


def _moved(links: DataFrame, points: DataFrame, end: str) -> DataFrame:
    """The links with one end where it points."""
    other = "v" if end == "u" else "u"
    return links.join(points, F.col(end) == F.col("c")).select(F.col("to").alias(end), other)
