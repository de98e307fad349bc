"""Connected components by joins: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.plans.scratch import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node it reaches.

    Alternates large-star and small-star rewiring (Kiveris et al., 2014): every round
    replaces the edges by links to the smallest neighbour, until the edges are a star
    around each component's smallest node. Rounds grow with the logarithm of the longest
    chain; each is cut by a table in the shared scratch folder, whose write also tells
    whether the round changed anything. A node's neighbours are
    never gathered: only their minimum is, with map-side combine, and joined back.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs, state = _stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        pairs, now = _stored(_small_star(_large_star(pairs)))
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stored(pairs: DataFrame) -> tuple[DataFrame, dict]:
    """The pairs, stored, and a fingerprint of them that the write itself gathers."""
    seen = Observation()
    watched = pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s"))
    return materialise(watched, "cc"), seen.get


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("lo"))
    least = least.select(F.col("u").alias("n"), F.least("u", "lo").alias("m"))
    out = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
    out = pairs.join(least, F.col("u") == F.col("n"))
    moved = out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    own = least.select(F.col("n").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own).distinct()
