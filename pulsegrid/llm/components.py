"""Connected components by star contraction, as Spark jobs over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_table, write_table


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node in edges (a, b); null ends are left out.

    Each round ties the larger neighbours of every node, then its smaller ones, to the least neighbour. The sums
    of the edge table end the rounds; each round's edges are written to the shared folder.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = F.min("b").alias("m")

    def large(e: DataFrame) -> DataFrame:
        near = both(e)
        m = near.groupBy("a").agg(least).select("a", F.least("a", "m").alias("m"))
        return near.where("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = down.groupBy("a").agg(least)
        moved = down.join(m, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionAll(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    now, last = write_table(edges.where("a <> b").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        before, last = now, mark
        now = write_table(small(large(before)), "edges")
        drop_table(before)
    pairs = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return pairs.unionAll(pairs.select(F.col("root").alias("node"), "root")).distinct()
