"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.workspace import written


def components(links: DataFrame) -> DataFrame:
    """One row (node, root) per linked node of links (a, b) other than the root, the component's smallest.

    Alternates large-star and small-star steps: each node hooks its neighbours to the smallest
    one, which halves long chains. Each round is a grouping and a shuffle of the links; the links
    never leave the executors, and a table is written per round so that lost executors cost one.
    """
    edges = written(links, "links")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))
        large = large.filter("x <> y").distinct()
        # small star: to every node's smaller neighbours and itself, the smallest of them
        low2 = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low2, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).union(low2.select("x", F.col("m").alias("y")))
        edges = written(small.filter("x <> y").distinct().select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "links")
        # done when every node hangs on one root and no root hangs on another
        hung_twice = edges.groupBy("b").count().filter("count > 1").limit(1).count()
        if not hung_twice and not edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
