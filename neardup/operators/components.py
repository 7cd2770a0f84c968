"""Connected components of an edge DataFrame (transitive closure of "similar").

Alternating large-star / small-star (Kiveris et al., "Connected Components in
MapReduce and Beyond", SoCC 2014): O(log^2 n) rounds, each a few hash
aggregates and equi-joins. Per-node minima are partial aggregates. They are
written before the edges are joined with them: then both sides of the join are
plain shuffles, a shape whose hot partitions AQE splits, so a hub with a third of
all edges does not end up in one task. Each round is cut the same way; the loop
stops when the edges form disjoint stars centred on each component's smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from neardup.session import cut_lineage


def _normalise(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
            .where(F.col("lo") != F.col("hi")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    m = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    # each larger neighbour hi of lo is re-hung on m(lo)
    out = e.join(m, e["lo"] == m["u"]).select(F.col("m").alias("lo"), "hi")
    return out.where(F.col("lo") != F.col("hi")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    m = cut_lineage(e.groupBy("hi").agg(F.min("lo").alias("m")))   # lo < hi always, so m < hi
    j = e.join(m, "hi")
    nbrs = j.select(F.least("lo", "m").alias("lo"), F.greatest("lo", "m").alias("hi"))
    centre = m.select(F.col("m").alias("lo"), "hi")
    return nbrs.unionByName(centre).where(F.col("lo") != F.col("hi")).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """True when every ``hi`` has one edge and no ``lo`` is also a ``hi`` (one job)."""
    roles = e.select(F.col("lo").alias("x"), F.lit(0).alias("as_hi"), F.lit(1).alias("as_lo")).unionByName(
        e.select(F.col("hi").alias("x"), F.lit(1).alias("as_hi"), F.lit(0).alias("as_lo")))
    bad = (roles.groupBy("x").agg(F.sum("as_hi").alias("nh"), F.max("as_lo").alias("lo"))
           .where((F.col("nh") > 1) | ((F.col("nh") > 0) & (F.col("lo") > 0))))
    return bad.limit(1).count() == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         max_rounds: int = 100) -> DataFrame:
    """(id, component) for every id in an edge; component = smallest id of its component."""
    e = cut_lineage(_normalise(edges, src, dst))
    for _ in range(max_rounds):
        e = cut_lineage(_small_star(cut_lineage(_large_star(e))))
        if _is_star_forest(e):
            break
    else:
        raise RuntimeError("connected components did not converge")
    leaves = e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return leaves.unionByName(roots)
