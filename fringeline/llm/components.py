"""Connected components of links between documents, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeline.llm.shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """node and the smallest node it reaches (root), for each node of links (a, b).

    Large-star and small-star rounds: every node hands the smallest neighbour it sees to its other neighbours,
    until the edges are stars.  The rounds grow as the logarithm of the longest chain.  Nulls and loops link nothing.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = written(small, "edges")
        stars = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
        stars = stars and new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").limit(1).count() == 0
        discard(edges)
        edges = new
        if stars:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
