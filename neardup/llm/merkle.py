"""Merkle manifest of a dataset: one tree for each source, one tree over the sources' roots.

A leaf is the digest of a row's fields. Runs of ``ARITY`` consecutive nodes become
their digest until one node is left; digests enter as hex text.

* Leaves get their place in their source from a range-sorted table and the row counts of
  its partitions, so a source with a third of all rows is sorted, numbered and
  reduced by many tasks.
* A superblock holds the ``SPAN`` nodes under one node ``HEIGHT`` levels up. Upwards, each
  superblock is reduced to that node by one grouped task; the nodes form the next
  table, a ``SPAN``-th as long, until each source has one node. The sources' roots go through the
  same steps as one more tree.
* Downwards, the nodes of a superblock and the outer nodes that its proofs need are
  cogrouped by superblock: one function finishes the local reduction, joins local and outer
  siblings to proofs and folds each proof from the claimed leaf. Outer nodes are sent once for
  each superblock (at most ``ARITY`` - 1 a level), not once for each row.

No group exceeds ``SPAN`` rows, nothing is collected, no size is assumed.

Defined cases: a null field enters as ``-``, an empty one as ``0:``; rows of a null source
are a tree of their own, before the others; null ids come first; rows of equal id go by
their leaves, rows equal in these too by file and place (their results are equal);
an empty table gives an empty result; columns other than the fields are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from neardup.llm.common import ROW_ID, scannable, with_row_id
from neardup.session import cut_lineage, ship_by_value

ship_by_value(__name__)

ARITY = 16
HEIGHT = 3
SPAN = ARITY ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of each field's UTF-8 byte count, a colon and its value; ``-`` for null."""
    def enter(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(enter, fields)), 256)


def digest(hexes: str) -> str:
    import hashlib
    return hashlib.sha256(hexes.encode()).hexdigest()


def rise(nodes: list[str], total: int) -> list[list[str]]:
    """The levels over a superblock of a level with ``total`` nodes, the superblock's own first."""
    levels = [nodes]
    while total > 1 and len(levels) <= HEIGHT:
        below = levels[-1]
        levels.append([digest("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
        total = -(-total // ARITY)
    return levels


def around(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each level but the last, what stands before and after each node in its run."""
    out = []
    for nodes in levels[:-1]:
        texts = []
        for i in range(0, len(nodes), ARITY):
            run = nodes[i:i + ARITY]
            texts += [("".join(run[:k]), "".join(run[k + 1:])) for k in range(len(run))]
        out.append(texts)
    return out


def path(sides: list[list[tuple[str, str]]], i: int) -> list[tuple[str, str]]:
    """(before, after) at each level from node ``i`` of a superblock to its top."""
    found = []
    for texts in sides:
        found.append(texts[i])
        i //= ARITY
    return found


def placed(rows: DataFrame, tree: str, order: list) -> DataFrame:
    """``rows`` with place (from 0, by ``order`` within ``tree``) and total (rows of the tree)."""
    ranged = rows.repartitionByRange(F.col(tree), *order).sortWithinPartitions(F.col(tree), *order)
    ranged = cut_lineage(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    runs = ranged.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut_lineage(runs.select(
        tree, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(tree)).alias("total")))
    out = ranged.join(runs, [tree, "part"])
    return out.withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def block() -> Column:
    return F.expr(f"place div {SPAN}").alias("block")


def tops(nodes: DataFrame) -> DataFrame:
    """(tree, place, total, digest) of the node over each superblock of (tree, place, total, digest)."""
    def reduce(frame):
        import pandas as pd
        frame = frame.sort_values("place")
        total = int(frame["total"].iloc[0])
        return pd.DataFrame({"tree": [frame["tree"].iloc[0]], "place": [int(frame["place"].iloc[0]) // SPAN],
                             "total": [-(-total // SPAN)], "digest": rise(list(frame["digest"]), total)[-1]})

    wanted = nodes.select("tree", "place", "total", "digest", block())
    return wanted.groupBy("tree", "block").applyInPandas(reduce, "tree string, place long, total long, digest string")


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots): the tables that still have several superblocks in a tree, and (tree, level, digest) of each tree's root."""
    levels, roots = [nodes], None
    while True:
        over = cut_lineage(tops(levels[-1]))
        done = over.where(F.col("total") == 1).select("tree", F.lit(len(levels) - 1).alias("level"), "digest")
        roots = done if roots is None else roots.unionByName(done)
        more = over.where(F.col("total") > 1)
        if more.isEmpty():
            return levels, roots
        levels.append(more)


OUTER = "tree string, block long, step int, before string, after string, subroot string, root string"


def descend(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The outer nodes needed by the superblocks under ``nodes``, from those needed by the nodes' own superblocks.

    A step is one level of a path, numbered from the top down (the lowest level has the
    largest step); step 0 carries the roots only.
    """
    def extend(frame, need):
        import pandas as pd
        frame = frame.sort_values("place")
        sides = around(rise(list(frame["digest"]), int(frame["total"].iloc[0])))
        need = need.sort_values("step")
        inherited = list(zip(need["step"].tolist(), need["before"], need["after"]))
        last = inherited[-1][0]
        rows = []
        for i, place in enumerate(frame["place"].tolist()):
            own = path(sides, i)
            rows += [(place, *x) for x in inherited]
            rows += [(place, last + len(own) - k, b, a) for k, (b, a) in enumerate(own)]
        out = pd.DataFrame(rows, columns=["block", "step", "before", "after"])
        return out.assign(tree=frame["tree"].iloc[0], subroot=need["subroot"].iloc[0], root=need["root"].iloc[0])

    wanted = nodes.select("tree", "place", "total", "digest", block())
    return wanted.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(extend, OUTER)


def proofs(leaves: DataFrame, outer: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns of (tree, place, total, digest, claimed) leaves with subroot, root, proof, folded_root and verified."""
    types = dict(leaves.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "subroot string", "root string", "proof string", "folded_root string",
                        "verified boolean"])

    def finish(frame, need):
        frame = frame.sort_values("place")
        levels = rise(list(frame["digest"]), int(frame["total"].iloc[0]))
        sides = around(levels)
        need = need.sort_values("step", ascending=False)
        above = [(b, a) for s, b, a in zip(need["step"], need["before"], need["after"]) if s > 0]
        tail = "".join(b + a for b, a in above)
        root = need["root"].iloc[0]
        texts, folded = [], []
        for i, x in enumerate(frame["claimed"]):
            own = path(sides, i)
            texts.append("".join(b + a for b, a in own) + tail)
            for before, after in own:
                x = digest(before + x + after)
            for before, after in above:
                x = digest(before + x + after)
            folded.append(x)
        out = frame[kept].copy()
        return out.assign(subroot=need["subroot"].iloc[0], root=root, proof=texts, folded_root=folded,
                          verified=[x == root for x in folded])

    wanted = leaves.select("tree", "place", "total", "digest", "claimed", *kept, block())
    return wanted.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source: str = "source",
             claimed: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: id, leaf, subroot, root, proof, folded_root, verified.

    proof is the hex text of all siblings, level by level up to the root, left to right.
    ``claimed`` gives changed values of fields: folded_root is the root that follows from the
    leaf of these values and the proof, verified whether it is the root. Without it the
    proofs are folded from the rows themselves.
    """
    docs = scannable(docs)
    changed = claimed or {}
    rows = with_row_id(docs).select(
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("tree"), F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in fields]).alias("digest"),
        leaf_digest([changed.get(c, F.col(c)) for c in fields]).alias("claimed"), *ROW_ID)
    ordered = placed(rows, "tree", [F.col("id").asc_nulls_first(), F.col("digest"), *map(F.col, ROW_ID)])
    leaves = cut_lineage(ordered.select("tree", "place", "total", "digest", "claimed", "id").withColumn("leaf", F.col("digest")))

    levels, roots = climb(leaves)
    sources = placed(roots.select(F.lit("").alias("over"), "tree", "level", "digest"), "over", [F.col("tree")])
    sources = cut_lineage(sources)
    upper, top = climb(sources.select(F.col("over").alias("tree"), "place", "total", "digest"))
    crown = top.select("tree", F.lit(0).cast("long").alias("block"), F.lit(0).alias("step"), F.lit("").alias("before"),
                       F.lit("").alias("after"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper):
        crown = cut_lineage(descend(nodes, crown))
    # what each source's own top superblock needs
    outer = crown.select(F.col("block").alias("place"), "step", "before", "after", "root").join(
        sources.select("place", F.col("tree").alias("of"), "level", F.col("digest").alias("subroot")), "place")
    outer = cut_lineage(outer.select(F.col("of").alias("tree"), "level", F.lit(0).cast("long").alias("block"), "step", "before",
                                     "after", "subroot", "root"))
    need = None
    for level in reversed(range(len(levels))):
        own = outer.where(F.col("level") == level).drop("level")
        need = own if need is None else own.unionByName(need)
        if level:
            need = cut_lineage(descend(levels[level], need))
    out = proofs(leaves, need, ["id", "leaf"])
    return out.withColumnRenamed("id", id_col)
