"""Connected components over a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import dropped, written


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _both(edges).where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: two long columns (a, b). Returns (node, label) for every node that has a link and isn't its component's smallest.

    Each round is two group-minimum joins and is written to the shared folder, so a lost executor costs a
    round at most; the number of rounds grows with the logarithm of the longest chain. It ends when the edges are
    stars: every node has one parent, and no parent has one itself. Nothing is collected but a count. Links from a
    node to itself and null ends are ignored; an empty table gives an empty one.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        # tables of their own: the join with a label that has very many edges may then be dealt anew, or broadcast by its size
        least = written(_both(edges).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(_large_star(edges, least), "edges")
        after = written(_small_star(large), "edges")
        for table in (least, large, edges):
            dropped(table)
        edges = after
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        open_nodes = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or child = 1 and parent = 1").count()
        if not open_nodes:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
