"""The whole dataflow: manifest -> exact groups -> near-duplicate groups -> ranked members.

The driver only sees scalars: the number of distinct fingerprints (strategy
choice), the size of the fullest bucket (hot-bucket path, only when it could
matter), the component loop's convergence test and the largest group size (read
from the materialised group table). Lineage is cut by Parquet writes under the
checkpoint dir; no rows are collected but the band planner's sample of at most 1,024 fingerprints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from neardup import constants as C
from neardup.operators.components import connected_components
from neardup.operators.exact import exact_hash_groups, exact_members, exclude_exact
from neardup.operators.hamming import (HOT_BUCKET_ROWS, band_links, choose_strategy, collapse,
                                       largest_bucket, leader_edges, lsh_index, lsh_pairs, lsh_positions,
                                       validate_threshold)
from neardup.operators.pigeonhole import general_plan
from neardup.operators.ranking import global_index
from neardup.operators.selection import best_per_group, effective_strategy, rank_members
from neardup.session import cut_lineage

MODES = ("both", "exact_only", "perceptual_only")
GROUP_COLUMNS = ["group_id", "match_type", "path", "member_rank", "is_best", "width", "height",
                 "file_size", "quality_score"]
_MEMBER_COLS = ["id", "path", "mtime", "width", "height", "file_size", "quality_score"]


def perceptual_candidates(manifest: DataFrame, hash_groups: DataFrame | None) -> DataFrame:
    """Rows with a fingerprint, minus every member of an exact group (when given)."""
    c = manifest.where(F.col("fp").isNotNull())
    return exclude_exact(c, hash_groups) if hash_groups is not None else c


def perceptual_components(candidates: DataFrame, threshold: int, bits: int = 256,
                          use_lsh: bool = False, lsh_tables_bits: tuple[int, int] | None = None,
                          target_recall: float = 0.99, hot_bucket_rows: int = HOT_BUCKET_ROWS) -> DataFrame:
    """(id, component) for candidates that have at least one similar row.

    The exact band join returns links that connect each tile's near rows, fewer than the tile has rows
    (``band_links``), so a near-duplicate cluster holding a large share of all rows costs no edge for each of its pairs.

    When a bucket of LSH holds more than ``hot_bucket_rows`` fingerprints, every member is first linked to its
    bucket leader when within the threshold, components of those star edges are formed, and the pair join then
    emits only pairs between different provisional components. Skipped pairs join nodes that
    are already connected, so the components are the same while the number of
    emitted edges stays linear in the cluster.
    """
    n_words = bits // 64
    reps, copies = collapse(candidates)
    n = reps.count()
    plan = None if use_lsh else general_plan(reps, n, bits, threshold)
    strat = choose_strategy(n, bits, threshold, use_lsh, lsh_tables_bits, target_recall, plan)
    copy_edges = copies.select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    if strat.kind == "bands":
        return connected_components(band_links(reps, n_words, strat.band_plan).unionByName(copy_edges))
    pos = lsh_positions(strat.tables, strat.bits_per_table, bits)
    index, cols = lsh_index(reps, n_words, pos), ["table_idx", *[f"k{i}" for i in range(n_words)]]
    # no bucket can outgrow the number of fingerprints: skip the measuring job then
    if n > hot_bucket_rows and largest_bucket(index, cols) > hot_bucket_rows:
        stars = cut_lineage(leader_edges(index, cols, n_words, threshold))
        provisional = connected_components(stars)
        edges = stars.unionByName(lsh_pairs(reps, n_words, pos, threshold, comp=provisional).select("src", "dst"))
    else:
        edges = lsh_pairs(reps, n_words, pos, threshold).select("src", "dst")
    return connected_components(edges.unionByName(copy_edges))


def find_duplicates(manifest: DataFrame, threshold: int = C.DEFAULT_THRESHOLD, mode: str = "both",
                    use_lsh: bool = False, bits: int = 256, strategy: str = "quality",
                    valid_only: bool = True, lsh_tables_bits: tuple[int, int] | None = None,
                    target_recall: float = 0.99, hot_bucket_rows: int = HOT_BUCKET_ROWS, materialize: bool = True) -> DataFrame:
    """Groups table (one row per member): GROUP_COLUMNS + id, mtime, selected.

    Exact groups come first (ids from 1, ordered by their smallest path), then
    near-duplicate groups, whose members exclude every exact-group member unless
    ``mode='perceptual_only'``. ``member_rank`` orders each group under
    ``strategy`` and ``selected`` marks its rank 1; ``is_best`` marks the best by
    quality, which reports and action plans keep whatever the strategy. Pairs are
    exact unless ``use_lsh`` asks for LSH (see ``choose_strategy``). With ``materialize`` the table is
    written under the checkpoint dir and read back, so reports, exports and
    action plans built on it do not recompute the dataflow.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    validate_threshold(threshold, bits)
    m = manifest.where(F.col("error").isNull()) if valid_only else manifest
    # one pass over the source (fingerprints included); every later stage reads this
    m = cut_lineage(m.select(*_MEMBER_COLS, "file_hash", *(["fp"] if mode != "exact_only" else [])))
    parts = []
    hash_groups = None
    if mode != "perceptual_only":
        hash_groups = exact_hash_groups(m)
        ex = exact_members(m, hash_groups)
        parts.append(ex.select(*_MEMBER_COLS, F.lit("exact").alias("match_type"),
                               F.col("file_hash").alias("gkey"), "first_path"))
    if mode != "exact_only":
        cand = perceptual_candidates(m, hash_groups)
        comps = perceptual_components(cand, threshold, bits, use_lsh, lsh_tables_bits, target_recall, hot_bucket_rows)
        pm = cut_lineage(cand.join(comps, "id"))
        first = cut_lineage(pm.groupBy("component").agg(F.min("path").alias("first_path")))
        pm = pm.join(first, "component")
        parts.append(pm.select(*_MEMBER_COLS, F.lit("perceptual").alias("match_type"),
                               F.col("component").cast("string").alias("gkey"), "first_path"))
    members = cut_lineage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    keys = members.groupBy("match_type", "gkey", "first_path").agg(F.count(F.lit(1)).alias("_n"))
    type_order = F.when(F.col("match_type") == "exact", F.lit(0)).otherwise(F.lit(1))
    ids = global_index(keys.withColumn("_t", type_order), ["_t", "first_path"], "group_id")
    largest = ids.agg(F.max("_n")).first()[0] or 0      # read from the materialised group table
    g = members.join(ids.select("match_type", "gkey", "group_id"), ["match_type", "gkey"])
    g = rank_members(g, strategy, largest_group=largest).withColumn("selected", F.col("member_rank") == 1)
    if effective_strategy(strategy) == "quality":
        g = g.withColumn("is_best", F.col("selected"))
    else:
        g = cut_lineage(g)
        best = cut_lineage(best_per_group(g).select("group_id", "best_path"))
        g = g.join(best, "group_id").withColumn("is_best", F.col("path") == F.col("best_path"))
    g = g.select(*GROUP_COLUMNS, "id", "mtime", "selected")
    return cut_lineage(g) if materialize else g
