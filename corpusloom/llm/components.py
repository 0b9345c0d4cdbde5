"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    Edges stay (child, parent) pairs with parent < child. Each round is written to the shared folder,
    so a lost executor repeats one round at most. No neighbour list is ever gathered: both steps use
    minima and joins only.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(src, dst).alias("child"), F.least(src, dst).alias("parent")).filter("child <> parent").distinct()
    now = materialize(pairs, "cc", slim=True)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("child", "parent") % 1000003)).first())
    seen = mark(now)
    while True:
        lowest = now.groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("low"))
        large = now.join(lowest, "parent", "left").select("child", F.coalesce("low", "parent").alias("parent"))
        low = F.min("parent").over(Window.partitionBy("child"))
        both = F.explode(F.array(F.col("child"), F.col("parent")))
        small = large.select("child", "parent", low.alias("low")).select(both.alias("child"), F.col("low").alias("parent"))
        after = materialize(small.filter("child <> parent").distinct(), "cc", slim=True)
        discard(now)
        now, before = after, seen
        seen = mark(now)
        if seen == before:
            return now.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(now.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct())
