"""Connected components of a link table, by alternating large-star and small-star rounds on written tables.

No link, node or component reaches the driver; a round is two aggregations by node and two joins, and a node that holds a
large share of the links is aggregated map-side and split by AQE in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametide.llm.common import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node that has a link to another; ``root`` is the smallest node reachable. Longs, no nulls.

    Links may repeat, stand in either direction or join a node to itself; an empty table gives an empty table.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges, path = written(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before = path
        edges, path = written(small.select("e.*").filter("u > v").distinct(), "links")
        # stars: every node has one link, and no root has a link to a smaller node
        roots = edges.select(F.col("v").alias("u")).distinct()
        state = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
        settled = state["n"] == state["nodes"] and roots.join(edges, "u", "left_semi").isEmpty()
        dropped(spark, before)
        if settled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
