"""Connected components of links by hooking to smaller neighbours and pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b: long, not null) reaches.

    Alternates large stars (a node's larger neighbours go to its smallest one) and small stars (its smaller neighbours
    and itself do) until the links are stars. Loops and repeated links change nothing. Sums are pre-aggregated per
    task; a hub's neighbours need only its minimum, which is joined back, so no group is gathered in one task.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = durable(edges)
    last = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("x"), F.col("b").alias("y")).where("x <> y").distinct()
        large = large.select(F.col("x").alias("a"), F.col("y").alias("b"))  # a < b holds: m <= a < b
        under = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(under, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = durable(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
        if tuple(state)[:2] == last and state[0] == state[2]:
            break
        if state[0] == state[2] and not edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            break  # every node has one link, to a node that has none upwards: stars
        last = tuple(state)[:2]
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
