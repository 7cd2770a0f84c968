"""Gap-free numbering without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` (and ``partitionBy(group)`` on a
hot group) funnels rows through one task. Instead the rows are range-partitioned
on the full ordering (a hot key is split across partitions), numbered locally
with ``monotonically_increasing_id`` and shifted by per-partition offsets. The
offset table has one row per partition, so its broadcast is bounded by the
partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from neardup.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row-in-partition


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def global_index(df: DataFrame, order: list, idx_col: str = "idx", start: int = 1) -> DataFrame:
    """Add ``idx_col`` = start + position of the row in ``order`` (must be a total order)."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = (df.repartitionByRange(_partitions(df), *order_cols)
               .sortWithinPartitions(*order_cols)
               .withColumn("_mid", F.monotonically_increasing_id()))
    # pin the partitioning: both branches below must see the same range bounds,
    # and a reliable checkpoint also survives the loss of an executor
    ordered = cut_lineage(ordered)
    ordered = (ordered.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
               .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    counts = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    out = ordered.join(F.broadcast(offsets), "_pid")
    return (out.withColumn(idx_col, (F.lit(start) + F.col("_off") + F.col("_loc")).cast("bigint"))
            .drop("_mid", "_pid", "_loc", "_off"))


def running_total(df: DataFrame, order: list, value: str, total_col: str) -> DataFrame:
    """Add ``total_col``: the sum of ``value`` over the rows before this one in ``order`` (which must break all ties).

    As in ``global_index`` rows are summed by range partitions and shifted by the partitions' totals.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(_partitions(df), *order_cols).withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    local = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_pid").agg(F.sum(value).alias("_all"))
    shifts = sums.select("_pid", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    out = ranged.withColumn(total_col, F.coalesce(F.sum(value).over(local), F.lit(0))).join(F.broadcast(shifts), "_pid")
    return out.withColumn(total_col, F.col(total_col) + F.col("_before")).drop("_pid", "_before")


# A window partition is sorted by one task; groups up to this size are cheap there.
WINDOW_MAX_GROUP_ROWS = 1_000_000


def rank_in_group(df: DataFrame, group_cols: list[str], order: list, rank_col: str = "rank",
                  max_window_rows: int = WINDOW_MAX_GROUP_ROWS, largest_group: int | None = None) -> DataFrame:
    """``row_number()`` within ``group_cols`` by ``order`` (which must break all ties).

    The largest group is measured first (a partial aggregate). While it stays
    within ``max_window_rows`` a partitioned window does the ranking in one
    shuffle; beyond that the rows are ranked by a global range-partitioned order,
    so a group holding a third of all rows is spread over many tasks and its
    first position comes from a partially aggregated ``min``. A caller that
    already knows the largest group size passes it as ``largest_group``.
    """
    biggest = largest_group if largest_group is not None else (
        df.groupBy(*group_cols).count().agg(F.max("count")).first()[0] or 0)
    if biggest <= max_window_rows:
        w = Window.partitionBy(*group_cols).orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w).cast("int"))
    idx = global_index(df, [*group_cols, *order], "_gidx")
    # written, so that AQE can split the hot group's rows in the join below
    first = cut_lineage(idx.groupBy(*group_cols).agg(F.min("_gidx").alias("_gfirst")))
    out = idx.join(first, group_cols)
    return out.withColumn(rank_col, (F.col("_gidx") - F.col("_gfirst") + 1).cast("int")).drop("_gidx", "_gfirst")


def desc_nulls_last(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_last()


def asc_nulls_last(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()
