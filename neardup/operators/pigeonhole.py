"""General pigeonhole plans: a radius of its own for each band, by measured collisions.

Two fingerprints within ``t`` bits can't differ by more than ``radius_i`` bits in every band i once the
sum of (radius_i + 1) exceeds t (Qin et al., "GPH: Similarity Search in Hamming Space",
ICDE 2018); equal radii t div m are the special case that wastes up to m - 1 of that sum. A
radius of -1 leaves a band out.

Bits of real fingerprints are neither uniform nor independent, so what a radius costs is
measured: a sample of the fingerprints, fixed by their hashes and bounded by ``SAMPLE``
rows whatever the table's size, gives for each band how often two fingerprints are
within each radius there. Probes (values within the radius) plus expected candidates are
then minimised over the radii by dynamic programming, and over the number of bands. A probe is a row that is
shuffled and sorted, a candidate is one of numpy's comparisons (``operators.buckets``), so beyond ``SMALL_ROWS`` fingerprints a probe counts
``PROBE_COST`` times. Up to ``PLAN_ROWS`` of them the plan is that of so many: probes a row are then the same at all
sizes, and what is shuffled grows as the table does. Where the bands let so many candidates through that comparing all pairs costs less (18
of 64 bits: nearly half of all pairs, by 260 probes a row), the plan is one band of no bits (``whole_plan``), compared in large tiles.
The sample and the weights only move the cost: any plan finds all pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame, functions as F

from neardup.operators.hamming import BandPlan, band_index, layout, make_band_plan, masks_within, min_bands, plan_bands, whole_plan

#: Rows of the sample; its pairs (half a million) are what the chances are counted on.
SAMPLE = 1024
MAX_PROBES = 20_000
#: Candidates that cost as much as a probe, and fingerprints from which and up to which plans are made with it.
PROBE_COST = 2_048
SMALL_ROWS, PLAN_ROWS = 2_048, 2_000_000
#: Candidates of small buckets that cost as much as a comparison of large tiles, for each word that it reads.
DENSE_COST = 0.25
#: Numbers of bands tried on each side of the best one under uniform bits.
AROUND = 4


def sample_words(reps: DataFrame, n_words: int, rep_col: str = "rep", fp_col: str = "fp", rows: int = SAMPLE):
    """(rows x words, unsigned) fingerprints with the smallest hashes of their ids."""
    words = [F.col(fp_col)[i].alias(f"w{i}") for i in range(n_words)]
    taken = reps.select(F.xxhash64(rep_col).alias("h"), *words).orderBy("h", *[f"w{i}" for i in range(n_words)]).limit(rows)
    found = np.array([list(r)[1:] for r in taken.collect()], dtype=np.int64)
    return found.reshape(-1, n_words).view(np.uint64)


def pair_differences(words):
    """The exclusive or of all pairs of the sample."""
    a, b = np.triu_indices(len(words), 1)
    return words[a] ^ words[b]


def band_chances(differences, start: int, end: int, largest: int):
    """Share of the pairs within 0, 1, .. ``largest`` bits of each other in bits [start, end) (bit 0 = MSB of word 0)."""
    apart = np.zeros(len(differences), dtype=np.int64)
    for k in range(differences.shape[1]):
        first, last = max(start, 64 * k) - 64 * k, min(end, 64 * k + 64) - 64 * k
        if first < last:
            mask = np.uint64(((1 << (last - first)) - 1) << (64 - last))
            apart += np.bitwise_count(differences[:, k] & mask)
    counted = np.bincount(np.minimum(apart, largest + 1), minlength=largest + 2)
    return np.cumsum(counted)[:largest + 1] / max(1, len(differences))


def uniform_chance(width: int, radius: int) -> float:
    return sum(comb(width, j) for j in range(radius + 1)) / 2.0 ** width


def allot(costs: list[list[float]], need: int) -> tuple[tuple[int, ...], float] | None:
    """Radii with sum of (radius + 1) = ``need`` and the least cost; ``costs[i][r + 1]`` is the cost of radius r in band i."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for band in costs:
        ahead: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, radii) in best.items():
            for steps, more in enumerate(band):
                total = used + steps
                if total <= need and (total not in ahead or cost + more < ahead[total][0]):
                    ahead[total] = (cost + more, (*radii, steps - 1))
        best = ahead
    return (best[need][1], best[need][0]) if need in best else None


def plan_for(differences, n: int, bits: int, threshold: int, m: int, probe_cost: float = 1.0) -> BandPlan | None:
    """The cheapest radii for ``m`` bands of equal width over ``n`` fingerprints."""
    bands = layout(bits, m)
    costs, chances = [], []
    for start, end in bands:
        width, row, chance = end - start, [0.0], []
        probes = 0
        for r in range(min(width, threshold) + 1):
            probes += comb(width, r)
            if probes > MAX_PROBES:
                break
            chance.append(r)
            row.append(probe_cost * probes)
        shares = band_chances(differences, start, end, len(chance) - 1) if len(differences) else np.zeros(len(chance))
        # a sample of pairs can't show chances below its own resolution
        shares = [max(float(s), uniform_chance(width, r)) for r, s in enumerate(shares)]
        costs.append([0.0, *(p + n * s for p, s in zip(row[1:], shares))])
        chances.append(shares)
    found = allot(costs, threshold + 1)
    if found is None:
        return None
    radii, _ = found
    used = [(e - s, r, c) for (s, e), r, c in zip(bands, radii, chances) if r >= 0]
    probes = sum(sum(comb(w, j) for j in range(r + 1)) for w, r, _ in used)
    return BandPlan(bits, threshold, bands, max(radii), probes, sum(n * c[r] for _, r, c in used), tuple(radii))


def general_plan(reps: DataFrame, n: int, bits: int, threshold: int, rep_col: str = "rep", fp_col: str = "fp") -> BandPlan:
    """The plan of least measured work for the fingerprints ``reps`` (``n`` distinct ones)."""
    rows, probe_cost = (n, 1) if n <= SMALL_ROWS else (max(n, PLAN_ROWS), PROBE_COST)

    def cost(plan: BandPlan) -> float:
        return probe_cost * plan.probes_per_row + plan.est_candidates

    differences = pair_differences(sample_words(reps, bits // 64, rep_col, fp_col))
    least, most = min_bands(bits), min(bits, max(threshold + 1, min_bands(bits)))
    equal = plan_bands(n, bits, threshold)
    if probe_cost > 1:
        equal = min((make_band_plan(bits, threshold, m, rows) for m in range(least, most + 1)), key=cost)
    middle = len(equal.bands)
    plans = [plan_for(differences, rows, bits, threshold, m, probe_cost)
             for m in range(max(least, middle - AROUND), min(most, middle + AROUND) + 1)]
    plans = [p for p in plans if p is not None]
    best = min(plans, key=cost) if plans else equal
    whole = whole_plan(bits, threshold, rows)
    dense = probe_cost * whole.probes_per_row + DENSE_COST * (bits // 64 + 1 >> 1) * whole.est_candidates
    return whole_plan(bits, threshold, n) if n > SMALL_ROWS and dense < cost(best) else best


def measured_work(reps: DataFrame, n_words: int, plan: BandPlan) -> DataFrame:
    """One row (probes, candidates): what the band join of ``plan`` looks up and compares, counted on the data."""
    index = band_index(reps, n_words, plan)
    values = index.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    arrays = F.lit(None).cast("array<bigint>")
    for k, ((start, end), r) in enumerate(zip(plan.bands, plan.allowed)):
        if r >= 0:
            arrays = F.when(F.col("band") == k, F.transform(
                F.array(*[F.lit(m).cast("bigint") for m in masks_within(end - start, r)]), lambda m: F.col("key").bitwiseXOR(m))
            ).otherwise(arrays)
    probes = values.select("band", "n", F.explode(arrays).alias("key"))
    met = probes.join(values.select("band", "key", F.col("n").alias("met")), ["band", "key"], "left")
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("probes"),
                   F.coalesce(F.sum(F.col("n") * F.coalesce("met", F.lit(0))), F.lit(0)).alias("candidates"))
