import random

import numpy as np
import pytest

from neardup.operators import hamming as H, pigeonhole as P
from test_hamming import brute, frame, random_fps, to_words


def skewed_fps(n, bits, seed):
    """Fingerprints whose first half hardly varies: equal radii waste their probes there."""
    rng = random.Random(seed)
    half = bits // 2
    base = rng.getrandbits(half)
    out = []
    for _ in range(n):
        high = base
        for _ in range(rng.randint(0, 4)):
            high ^= 1 << rng.randrange(half)
        low = rng.getrandbits(half)
        if out and rng.random() < 0.3:
            low = rng.choice(out) & ((1 << half) - 1)
            for _ in range(rng.randint(0, bits // 16)):
                low ^= 1 << rng.randrange(half)
        out.append(high << half | low)
    return out


@pytest.mark.parametrize("bits,t,make", [(256, 32, random_fps), (256, 10, skewed_fps), (64, 18, random_fps), (64, 9, skewed_fps),
                                         (64, 0, random_fps), (128, 40, skewed_fps)])
def test_general_plan_finds_all_pairs(spark, bits, t, make):
    fps = list(dict.fromkeys(make(150, bits, seed=bits + t)))
    df = frame(spark, fps, bits)
    plan = P.general_plan(df, len(fps), bits, t)
    assert sum(r + 1 for r in plan.allowed) > t
    got = [(r.src, r.dst, r.distance) for r in H.band_pairs(df, bits // 64, plan).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(fps, t)


def test_unequal_radii_and_unused_bands(spark):
    fps = random_fps(120, 64, seed=4)
    df = frame(spark, fps, 64)
    bands = H.layout(64, 5)
    for radii in [(3, -1, 2, 0, 1), (-1, -1, 5, 1, 0), (9, -1, -1, -1, -1)]:
        plan = H.BandPlan(64, sum(r + 1 for r in radii) - 1, bands, max(radii), 0, 0.0, radii)
        got = {(r.src, r.dst, r.distance) for r in H.band_pairs(df, 1, plan).collect()}
        assert got == brute(fps, plan.threshold)


def test_allotment_is_the_cheapest():
    rng = random.Random(2)
    for _ in range(50):
        costs = [[0.0, *sorted(rng.random() * 10 for _ in range(4))] for _ in range(4)]
        need = rng.randint(1, 9)
        every = [(sum(costs[i][s] for i, s in enumerate(steps)), steps)
                 for steps in np.ndindex(5, 5, 5, 5) if sum(steps) == need]
        radii, cost = P.allot(costs, need)
        assert sum(r + 1 for r in radii) == need and cost == pytest.approx(min(every)[0])
    assert P.allot([[0.0, 1.0]], 3) is None


def test_chances_count_pairs():
    words = np.array([[0b1], [0b11], [0b111 << 61]], dtype=np.uint64)
    diff = P.pair_differences(words)
    assert P.band_chances(diff, 0, 3, 3).tolist() == [1 / 3, 1 / 3, 1 / 3, 1.0]
    assert P.band_chances(diff, 61, 64, 2).tolist() == [0.0, 2 / 3, 1.0]


def test_measured_work_is_counted(spark):
    fps = random_fps(60, 64, seed=9)
    df = frame(spark, fps, 64)
    plan = P.general_plan(df, len(fps), 64, 6)
    work = P.measured_work(df, 1, plan).first()
    met = 0
    for a in fps:
        for b in fps:
            for (s, e), r in zip(plan.bands, plan.allowed):
                band = ((a ^ b) >> (64 - e)) & ((1 << (e - s)) - 1)
                met += r >= 0 and band.bit_count() <= r
    assert work.candidates == met
    assert work.probes == len(fps) * plan.probes_per_row


def test_skewed_bits_cost_less_than_equal_radii(spark):
    fps = list(dict.fromkeys(skewed_fps(400, 64, seed=1)))
    df = frame(spark, fps, 64)
    work = [sum(P.measured_work(df, 1, plan).first()) for plan in (P.general_plan(df, len(fps), 64, 9), H.plan_bands(len(fps), 64, 9))]
    assert work[0] < 0.8 * work[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "rep long, fp array<long>")
    plan = P.general_plan(df, 0, 256, 32)
    assert H.band_pairs(df, 4, plan).collect() == []


def test_probes_a_row_do_not_grow_with_the_table(spark):
    """What the band join shuffles is its probes: at ten times the rows, ten times as much."""
    fps = list(dict.fromkeys(random_fps(300, 256, seed=3)))
    df = frame(spark, fps, 256)
    small, large = (P.general_plan(df, n, 256, 32) for n in (50_000, 500_000))
    assert large.probes_per_row == small.probes_per_row <= 300
    got = {(r.src, r.dst, r.distance) for r in H.band_pairs(df, 4, large).collect()}
    assert got == brute(fps, 32)


def test_wide_radii_are_compared_whole(spark, monkeypatch):
    """Bands of 64 bits at 18 let nearly half of all pairs through, so all are compared, in tiles; each pair is found once."""
    fps = list(dict.fromkeys(random_fps(300, 64, seed=21)))
    df = frame(spark, fps, 64)
    plan = P.general_plan(df, 50_000, 64, 18)
    assert plan.bands == ((0, 0),)
    assert P.general_plan(df, 50_000, 64, 3).bands != ((0, 0),)
    monkeypatch.setattr(H, "OWN_ROWS", 40)
    got = [(r.src, r.dst, r.distance) for r in H.band_pairs(df, 1, plan).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(fps, 18)
