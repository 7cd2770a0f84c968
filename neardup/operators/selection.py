"""Keeper selection: which member of a group to keep, by strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from neardup import constants as C
from neardup.operators.ranking import rank_in_group


def effective_strategy(strategy: str) -> str:
    """Unknown names mean "quality"."""
    return strategy if strategy in C.STRATEGIES else "quality"


def strategy_order(strategy: str) -> list[Column]:
    """Sort keys, best first; ties broken by path.

    A missing mtime sorts last for both "newest" and "oldest".
    """
    s = effective_strategy(strategy)
    key = {
        "quality": F.col("quality_score").desc_nulls_last(),
        "largest": F.col("file_size").desc_nulls_last(),
        "smallest": F.col("file_size").asc_nulls_last(),
        "newest": F.col("mtime").desc_nulls_last(),
        "oldest": F.col("mtime").asc_nulls_last(),
    }[s]
    return [key, F.col("path").asc()]


def rank_members(members: DataFrame, strategy: str = "quality", rank_col: str = "member_rank",
                 largest_group: int | None = None) -> DataFrame:
    """``rank_col`` = position of the member in its group under ``strategy`` (1 = keep)."""
    return rank_in_group(members, ["group_id"], strategy_order(strategy), rank_col, largest_group=largest_group)


def selections(groups: DataFrame, strategy: str = "quality") -> DataFrame:
    """(group_id, path, decision) with exactly one 'keep' per group."""
    r = rank_members(groups.select("group_id", "path", "quality_score", "file_size", "mtime"),
                     strategy, "_r")
    return r.select("group_id", "path",
                    F.when(F.col("_r") == 1, F.lit("keep")).otherwise(F.lit("delete")).alias("decision"))


def best_per_group(groups: DataFrame) -> DataFrame:
    """(group_id, best_path, best_quality): argmax quality, ties to the smallest path.

    One partial aggregate (``min_by`` over a (-quality, path) key), so a huge
    group is reduced on the map side.
    """
    key = F.struct((-F.coalesce(F.col("quality_score"), F.lit(float("-inf")))).alias("q"),
                   F.col("path").alias("p"))
    return groups.groupBy("group_id").agg(F.min_by("path", key).alias("best_path"),
                                          F.max("quality_score").alias("best_quality"))


def apply_user_choice(groups: DataFrame, choices: DataFrame) -> DataFrame:
    """(group_id, keep_path): the user's choice per group wins, else the best by quality."""
    best = best_per_group(groups)
    return (best.join(choices.select("group_id", F.col("selected_keep")), "group_id", "left")
            .select("group_id", F.coalesce("selected_keep", "best_path").alias("keep_path")))
