"""Connected components of an edge table, by alternating large-star and small-star.

Each half step gives every node the smallest node it knows and hangs its neighbours
there; a fixed point is a forest of stars. Minima combine before the shuffle, and the
joins run on checkpointed tables, so adaptive execution can split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30))), F.lit(0))).first())


def _to_minimum(edges: DataFrame, keep_self: bool) -> DataFrame:
    """For each u with minimum m over its v (and u itself): its neighbours v > m point to m."""
    least = checkpoint(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = edges.join(least, "u")
    if keep_self:
        # small-star: all v are below u; u itself and the others hang on the smallest.
        pairs = met.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v")
    else:
        # large-star: of both directions, the neighbours above u hang on the smallest.
        pairs = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.distinct()


def connected_components(edges: DataFrame, *, most_rounds: int = 50) -> DataFrame:
    """Rows (node, root) of every node of an edge table (a, b: long); root is the least
    node of its component. Loops and repeated edges are fine; nulls are dropped; no
    edges give no rows. Raises RuntimeError if ``most_rounds`` don't reach a fixed point."""
    a, b = edges.columns[:2]
    e = checkpoint(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _signature(e)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = checkpoint(_to_minimum(both, keep_self=False))
        e = checkpoint(_to_minimum(stars, keep_self=True))
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
