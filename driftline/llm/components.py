"""Connected components of a large graph by alternating star operations.

Every round replaces edges by edges to smaller neighbours, so that in the end
each node points at the smallest node it can reach.  A round is two aggregates
and two joins; no neighbour list is ever gathered, so a node of any degree is
harmless, and only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import written


# A star step never adds edges, so the known count sizes the files of the next round.
EDGES_PER_FILE = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least, "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").where(F.col("v") != F.col("m"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1] or 0


def smallest_reachable(edges: DataFrame, u: str, v: str) -> DataFrame:
    """``node``, ``root``: for every node on an edge, the smallest node it can reach.

    ``u`` and ``v`` name two columns of one orderable type.  NULL ends and loops
    are ignored; repeated edges count once.  No edges give no rows.
    """
    ends = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    current = written(
        ends.where(edges[u].isNotNull() & edges[v].isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges"
    )
    state = _state(current)
    while state[0]:
        files = 1 + state[0] // EDGES_PER_FILE
        current = written(_small_star(_large_star(current)).coalesce(files), "edges")
        before, state = state, _state(current)
        if before == state:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
