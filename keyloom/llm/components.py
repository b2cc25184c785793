"""Connected components of a link table, by rounds of contraction to random neighbours' minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._shared import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b): long ids, any order, repeats and self links allowed. Returns (node, root) for every linked node.

    In a round each node points to the neighbour (or itself) of least rank, a hash of node and round, so an expected
    constant share of the nodes goes whatever the links' shape; links are then redrawn between the nodes pointed to.
    Minima are combined before the shuffle, so a node with very many links costs no task more than its partial rows.
    Pointers of the rounds are followed backwards at the end. Nulls are dropped. An empty table gives an empty result.
    """
    edges = written(links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    pointers: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(pointers))).alias("r"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.select(F.col("a").alias("node"), F.least(rank("a"), rank("b")).alias("m")).unionAll(edges.select(F.col("b").alias("node"), F.least(rank("a"), rank("b")).alias("m")))
        points = written(both.groupBy("node").agg(F.min("m").getField("n").alias("to")), "points")
        pointers.append(points)
        to = lambda c: points.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = written(moved.filter("a <> b").distinct(), "links")
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a node may point to one that points on in the same round; the nodes pointed to live on or are settled later
    roots = None
    for points in reversed(pointers):
        settled = points if roots is None else points.join(roots.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
        roots = settled.select("node", F.col("to").alias("root"))
        if points is not pointers[0]:
            roots = written(roots, "roots")
    return roots
