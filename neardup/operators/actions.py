"""Action plans for duplicates (delete / move / hardlink / symlink) as tables.

The plan is the dry run: one row per non-keeper member with the bytes it frees.
Applying it to a file system is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from neardup.functions.scalars import filename
from neardup.operators.ranking import rank_in_group
from neardup.session import cut_lineage

ACTIONS = ("delete", "move", "hardlink", "symlink")


_NAME = r"^(.+?)(\.[^.]*)?$"
_NUMBERED = r"^(.+)_([1-9][0-9]{0,8})(\.[^.]*)?$"


def unique_names(dupes: DataFrame, order: list, existing: DataFrame | None = None) -> DataFrame:
    """``dupes`` with ``_target_name``: no two alike, and none in ``existing`` (name).

    The first row of a basename (in ``order``) keeps it unless it exists already.
    The others get ``stem_1.ext``, ``stem_2.ext``, ..., leaving out every number
    whose name is some row's basename or exists. A numbered name belongs to one
    basename only, so numbers handed out for different basenames never meet.
    """
    named = cut_lineage(rank_in_group(dupes.withColumn("_name", filename("path")), ["_name"], order, "_k"))
    there = existing.select(F.col("name").alias("_name")).distinct() if existing is not None else None
    counts = named.groupBy("_name").agg(F.max("_k").cast("bigint").alias("_n"))
    if there is None:
        counts = counts.withColumn("_first_taken", F.lit(0))
        taken = counts.select("_name")
    else:
        counts = counts.join(there.withColumn("_t", F.lit(1)), "_name", "left").select(
            "_name", "_n", F.coalesce("_t", F.lit(0)).alias("_first_taken"))
        taken = counts.select("_name").unionByName(there).distinct()
    # numbers that can't be given: those of taken names of the form stem_number.ext
    used = taken.where(F.col("_name").rlike(_NUMBERED)).select(
        F.concat(F.regexp_extract("_name", _NUMBERED, 1), F.regexp_extract("_name", _NUMBERED, 3)).alias("_name"),
        F.regexp_extract("_name", _NUMBERED, 2).cast("bigint").alias("_number"))
    used = cut_lineage(used)
    need = counts.withColumn("_need", F.col("_n") - 1 + F.col("_first_taken")).where(F.col("_need") > 0)
    blocked = used.groupBy("_name").agg(F.count(F.lit(1)).alias("_blocked"))
    # as many numbers as are needed and blocked hold enough free ones
    numbers = need.join(blocked, "_name", "left").select(
        "_name", "_first_taken", "_need",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_need") + F.coalesce("_blocked", F.lit(0)))).alias("_number"))
    free = numbers.join(used, ["_name", "_number"], "left_anti")
    free = rank_in_group(free, ["_name"], ["_number"], "_free").where(F.col("_free") <= F.col("_need"))
    given = cut_lineage(free.select("_name", (F.col("_free") + 1 - F.col("_first_taken")).alias("_k"), "_number"))
    out = named.join(given, ["_name", "_k"], "left")
    stem, ext = F.regexp_extract("_name", _NAME, 1), F.regexp_extract("_name", _NAME, 2)
    return out.withColumn("_target_name", F.when(F.col("_number").isNull(), F.col("_name")).otherwise(
        F.concat(stem, F.lit("_"), F.col("_number").cast("string"), ext)))


def action_plan(groups: DataFrame, action: str, trash_dir: str | None = None,
                existing: DataFrame | None = None) -> DataFrame:
    """(group_id, path, action, target, keeper, bytes) for every non-best member.

    ``move`` targets ``trash_dir``/basename, made unique by ``unique_names`` in
    group, then rank order; ``existing`` (name) lists what the folder holds already.
    """
    if action not in ACTIONS:
        raise ValueError(f"action must be one of {ACTIONS}")
    if action == "move" and not trash_dir:
        raise ValueError("move needs trash_dir")
    keeper = groups.where(F.col("is_best")).select("group_id", F.col("path").alias("keeper"))
    dupes = groups.where(~F.col("is_best")).join(keeper, "group_id")
    if action == "move":
        named = unique_names(dupes, ["group_id", "member_rank", "path"], existing)
        dupes = named.withColumn("target", F.concat(F.lit(trash_dir.rstrip("/") + "/"), "_target_name"))
    elif action == "delete":
        dupes = dupes.withColumn("target", F.lit(None).cast("string"))
    else:
        dupes = dupes.withColumn("target", F.col("keeper"))
    return dupes.select("group_id", "path", F.lit(action).alias("action"), "target", "keeper",
                        F.col("file_size").alias("bytes"))


def action_summary(plan: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Dry-run totals: processed, skipped, errors, bytes saved.

    With a ``listing`` (path) of what is there now, a member that is gone is
    skipped, and one whose link target is gone is an error; neither frees bytes.
    """
    if listing is None:
        plan = plan.withColumns({"_there": F.lit(True), "_keeper": F.lit(True)})
    else:
        now = listing.select("path").distinct()
        plan = (plan.join(now.withColumn("_there", F.lit(True)), "path", "left")
                .join(now.select(F.col("path").alias("keeper"), F.lit(True).alias("_keeper")), "keeper", "left"))
    there = F.coalesce("_there", F.lit(False))
    fails = there & ~F.coalesce("_keeper", F.lit(False)) & F.col("action").isin("hardlink", "symlink")
    done = there & ~fails
    return plan.agg(F.count_if(done).cast("bigint").alias("processed"),
                    F.count_if(~there).cast("bigint").alias("skipped"),
                    F.count_if(fails).cast("bigint").alias("errors"),
                    F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).cast("bigint").alias("space_saved"))
