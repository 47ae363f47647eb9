"""Connected components by alternating large and small stars, in tables only.

While a graph has at most BROADCAST_EDGES edges (counted in the job that writes them, 16 bytes each), the nodes' least
neighbours are broadcast; larger graphs join them, in a form that Spark can split at nodes with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._store import stored

BROADCAST_EDGES = 300_000


def _large(e: DataFrame) -> DataFrame:
    """Each node's greater neighbours move to the least of it and its neighbours.

    Only nodes with a smaller neighbour move anything. Their least neighbours are a table of their own, so that Spark
    can split the join of a node with very many neighbours.
    """
    both = e.union(e.select("dst", "src")).toDF("u", "v")
    least = stored(e.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m")), "least")
    moved = both.where("v > u").join(least, "u", "left")
    return moved.select(F.col("v").alias("src"), F.coalesce("m", "u").alias("dst"))


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    least = stored(e.groupBy("src").agg(F.min("dst").alias("m")), "least")
    return e.join(least, "src").where("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(least.select("src", F.col("m").alias("dst")))


def _round(e: DataFrame) -> DataFrame:
    """One large and one small star, with the least neighbours broadcast."""
    least = e.groupBy(F.col("src").alias("u")).agg(F.min("dst").alias("m"))
    both = e.union(e.select("dst", "src")).toDF("u", "v").where("v > u")
    moved = both.join(F.broadcast(least), "u", "left").select(F.col("v").alias("src"), F.coalesce("m", "u").alias("dst"))
    low = moved.groupBy("src").agg(F.min("dst").alias("m"))
    return moved.join(F.broadcast(low), "src").select(F.when(F.col("dst") > F.col("m"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.col("m").alias("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for every node of an edge (src long, dst long; any order, repeats allowed, loops ignored)."""
    e, state = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst").distinct(), None
    while True:
        # A star forest is a fixed point: no node is both a centre and a leaf, and each leaf has one centre.
        seen = Observation()
        e = stored(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")), "edges")
        now = seen.get
        if now == state or not now["n"]:
            break
        state = now
        if now["n"] <= BROADCAST_EDGES:
            e = _round(e)
            continue
        e = _small(stored(_large(e).distinct(), "edges")).distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("comp")).union(e.select("dst", "dst").distinct().toDF("node", "comp"))
