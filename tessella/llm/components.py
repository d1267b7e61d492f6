"""Connected components of a distributed edge list (large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _minima(edges: DataFrame) -> DataFrame:
    """u -> the least of u and its neighbours; sums up before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Return ``node, component`` (the least node reachable) for each node of ``edges(a, b)``.

    Alternates the two star operations of Kiveris et al. (2014). Each round is two
    aggregations that combine before their shuffle and two joins whose hot keys AQE can
    split; the edge list is checkpointed each round and never leaves the executors. An
    empty edge list, loops and repeated edges are allowed; nulls are ignored.
    """
    known = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("a is not null and b is not null").distinct()
    known = checkpoint(known)
    loops = known.where("lo = hi").select(F.col("lo").alias("node"))
    links = known.where("lo <> hi")
    before = None
    for _ in range(max_rounds):
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        large = both.where("v > u").join(_minima(both), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = checkpoint(large)
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = _minima(down)
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        links = checkpoint(small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        if (now := (row["n"], row["s"])) == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = links.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return members.unionByName(roots).unionByName(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
