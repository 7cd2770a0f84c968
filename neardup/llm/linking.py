"""Connected groups of nodes that share buckets, without all pairs of a bucket.

Candidate pairs are the pairs of nodes in one bucket. A bucket may hold a third of
all nodes, so its pairs are not listed. Instead:

1. each node is tested against one node of each of its buckets, the bucket's leader. Leaders are
   chosen by an order of the nodes that differs from bucket to bucket, so a node of many
   buckets meets many others, those most like it most often;
2. the links found give provisional groups;
3. only in buckets that still hold several groups, the nodes outside the largest
   one are tested against the nodes of the other groups.

For sets the caller has a better third step: ``prefix_pairs`` finds the like sets among the nodes
of those buckets by their rarest elements instead of by the buckets.

Pairs left out are in one group already or can't be links, so the groups are those of all pairs
of all buckets. In a bucket of near copies step 1 does nearly everything and
the work is linear in the bucket.

Every aggregate is written before a join on its key reads it: then both sides
of the join are plain shuffles, and Spark can split a hot key's partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from neardup.operators.components import connected_components
from neardup.session import cut_lineage

Verify = Callable[[DataFrame], DataFrame]


def shared_buckets(members: DataFrame) -> DataFrame:
    """``led_buckets``, written."""
    return cut_lineage(led_buckets(members))


def led_buckets(members: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """(key, node, size, leader) of the buckets that hold two nodes or more; key and node are longs.

    Columns of ``about`` (leader, ..) come along with the leaders. The order is that of the nodes' numbers after an exclusive or with a hash of the
    key, which the same operation undoes.
    """
    mask = F.xxhash64("key")
    leaders = members.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("least"), F.count(F.lit(1)).alias("n"))
    leaders = leaders.where(F.col("n") > 1).select("key", F.col("least").bitwiseXOR(mask).alias("leader"))
    if about is not None:
        leaders = leaders.join(about, "leader")
    return members.join(cut_lineage(leaders), "key")


def link_groups(shared: DataFrame, sizes: DataFrame, verify: Verify,
                compatible: Callable[[Column, Column], Column],
                search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, component) of all nodes that have a link; component is the smallest node of the group.

    shared      rows of ``shared_buckets``
    sizes       (node, size) of all nodes; a size is whatever ``compatible`` compares
    verify      keeps the true links of a DataFrame (a, b) of distinct pairs, a < b
    compatible  cheap condition on the sizes of two nodes, without which they aren't linked
    search      for a DataFrame (node, component) a DataFrame (a, b), a < b, of distinct pairs that holds all links
                between different components; without it the buckets are searched
    """
    stars = shared.where(F.col("node") != F.col("leader")).select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    stars = cut_lineage(stars)
    sized = (stars.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("size_a")), "a")
             .join(sizes.select(F.col("node").alias("b"), F.col("size").alias("size_b")), "b"))
    links = cut_lineage(verify(sized.where(compatible(F.col("size_a"), F.col("size_b"))).select("a", "b")))
    groups = connected_components(links, "a", "b")

    labelled = shared.select("key", "node", "size").join(groups.withColumnRenamed("id", "node"), "node", "left")
    labelled = cut_lineage(labelled.withColumn("component", F.coalesce("component", "node")))
    largest = several(labelled, "key")
    if largest.isEmpty():
        return groups

    rows = labelled.join(largest, "key")
    if search is not None:
        pairs = search(rows.select("node", "component").distinct())
    else:
        rows = cut_lineage(rows)
        few = rows.where(F.col("component") != F.col("top")).select(
            "key", F.col("node").alias("x"), F.col("size").alias("size_x"), F.col("component").alias("cx"))
        pairs = few.join(rows, "key").where(
            (F.col("cx") != F.col("component")) & compatible(F.col("size_x"), F.col("size"))
            & ((F.col("component") == F.col("top")) | (F.col("x") < F.col("node"))))
        pairs = pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    more = cut_lineage(verify(cut_lineage(pairs).join(stars, ["a", "b"], "left_anti")))
    if more.isEmpty():
        return groups
    return connected_components(groups.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more), "a", "b")


def several(rows: DataFrame, key: str) -> DataFrame:
    """(key, top) of the keys whose rows are of several components; top is the largest one."""
    counted = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy(key).agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("groups"))
    return cut_lineage(largest.where(F.col("groups") > 1).select(key, F.col("top.component").alias("top")))


def prefix_pairs(elements: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of ``nodes`` (node, component) of different components that may reach the similarity.

    elements  (node, elements): the sets, arrays of longs

    All sets are put in one order of elements, those that few of these sets hold first. Of two sets with
    100 * common >= percent * all, each holds at least percent of its own size in common; so the first
    size - ceil(percent * size / 100) + 1 elements of one and of the other share an element (prefix filter, Chaudhuri et al. 2006).
    What follows the first shared element bounds what the two have in common (Xiao et al. 2008). Where
    an element's sets are mostly of one component, the others are compared with them and not they with each other.
    """
    each = elements.join(nodes, "node").select("node", "component", F.size("elements").alias("size"), F.explode("elements").alias("x"))
    held = cut_lineage(each.groupBy("x").agg(F.count(F.lit(1)).alias("held")))
    ordered = each.join(held, "x").groupBy("node").agg(
        F.first("component").alias("component"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("held", "x"))).alias("order"))
    count = F.expr(f"CAST(size - ({percent}L * size + 99) div 100 + 1 AS INT)")
    prefix = ordered.select("node", "component", "size", F.posexplode(F.slice("order", 1, count)).alias("at", "e"))
    prefix = cut_lineage(prefix.where(F.col("e.held") > 1).select("node", "component", "size", "at", F.col("e.x").alias("x")))
    rows = cut_lineage(prefix.join(several(prefix, "x"), "x"))
    few = rows.where(F.col("component") != F.col("top")).select(
        "x", F.col("node").alias("one"), F.col("component").alias("c1"), F.col("size").alias("size1"), F.col("at").alias("at1"))
    most = F.least(F.col("size1") - F.col("at1"), F.col("size") - F.col("at"))
    pairs = few.join(rows, "x").where(
        (F.col("c1") != F.col("component")) & ((F.col("component") == F.col("top")) | (F.col("one") < F.col("node")))
        & (100 * most >= percent * (F.col("size1") + F.col("size") - most)))
    return pairs.select(F.least("one", "node").alias("a"), F.greatest("one", "node").alias("b")).distinct()
