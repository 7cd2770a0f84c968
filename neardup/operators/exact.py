"""Exact duplicates: rows sharing a content hash (SHA-256)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from neardup.session import cut_lineage


def exact_hash_groups(manifest: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """One row per hash shared by more than one row: (hash, n, first_path).

    ``groupBy`` aggregates partially on the map side, so a hash carried by a third
    of all rows costs one row per task before the shuffle. NULL and empty hashes
    stand for files that could not be read and form no group. The table is written:
    joins with it then have plain shuffles on both sides, whose hot partitions AQE
    splits.
    """
    return cut_lineage(manifest.where(F.col(hash_col) != "")
                       .groupBy(hash_col)
                       .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))
                       .where(F.col("n") > 1))


def exact_members(manifest: DataFrame, hash_groups: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Rows of ``manifest`` that belong to an exact group, tagged with ``first_path``.

    The group side has one row per hash; a hot hash on the member side is split by
    AQE's skew-join handling instead of landing in one task.
    """
    return manifest.join(hash_groups.select(hash_col, "first_path"), hash_col)


def exclude_exact(candidates: DataFrame, hash_groups: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Anti-join: every member of an exact group leaves, keeper included; NULL hashes stay."""
    return candidates.join(hash_groups.select(hash_col), hash_col, "left_anti")
