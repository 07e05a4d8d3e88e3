"""Connected components of an edge table, by alternating stars.

Cases: edges with a null end, loops and repeated edges tie nothing; a node without an edge to another
node has no row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm.common import join_back, write_out

EDGES_PER_TASK = 200_000


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbourhood."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_back(both.where("v > u"), least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, are tied to the least of them (u > v throughout)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = join_back(e, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node of an edge (u, v); all work stays on the executors."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = write_out(e, "edges")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        tasks = max(1, -(-now[0] // EDGES_PER_TASK))  # the table shrinks from round to round
        e = write_out(_large_star(e).distinct().coalesce(tasks), "large_star")
        e = write_out(_small_star(e).distinct().coalesce(tasks), "small_star")
    # stars: every u is tied to its component's least node
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
