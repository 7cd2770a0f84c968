import random

import pytest
from pyspark.sql import functions as F

from neardup.operators import hamming as H


def random_fps(n, bits, seed, near=0.3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < near:
            base = rng.choice(out)
            v = base
            for _ in range(rng.randint(0, bits // 8)):
                v ^= 1 << rng.randrange(bits)
        else:
            v = rng.getrandbits(bits)
        out.append(v)
    return out


def to_words(v, bits):
    words = []
    for k in range(bits // 64):
        w = (v >> (bits - 64 * (k + 1))) & ((1 << 64) - 1)
        words.append(w - (1 << 64) if w >= 1 << 63 else w)
    return words


def frame(spark, fps, bits):
    return spark.createDataFrame([(i, to_words(v, bits)) for i, v in enumerate(fps)], "rep long, fp array<long>")


def brute(fps, t):
    return {(i, j, bin(fps[i] ^ fps[j]).count("1")) for i in range(len(fps)) for j in range(i + 1, len(fps))
            if bin(fps[i] ^ fps[j]).count("1") <= t}


@pytest.mark.parametrize("bits,t", [(256, 10), (256, 32), (64, 18), (64, 0), (128, 40)])
def test_band_pairs_equal_brute_force(spark, bits, t):
    fps = random_fps(150, bits, seed=bits + t)
    df = frame(spark, fps, bits)
    exact = brute(fps, t)
    for plan in (H.plan_bands(len(fps), bits, t), H.pigeonhole_plan(bits, t)):
        got = {(r.src, r.dst, r.distance) for r in H.band_pairs(df, bits // 64, plan).collect()}
        assert got == exact


def test_band_plan_is_valid():
    for bits, t in [(256, 10), (256, 32), (64, 18), (64, 63), (256, 0)]:
        p = H.plan_bands(10_000, bits, t)
        assert sum(e - s for s, e in p.bands) == bits
        assert all(e - s <= 63 for s, e in p.bands)
        assert p.radius == t // len(p.bands)


def test_lsh_pairs_subset_and_ordering(spark):
    bits, t = 256, 32
    fps = random_fps(200, bits, seed=7, near=0.5)
    df = frame(spark, fps, bits)
    pos = H.lsh_positions(15, 20, bits)
    cand = H.lsh_pairs(df, 4, pos, None).collect()
    pairs = [(r.src, r.dst) for r in cand]
    assert len(pairs) == len(set(pairs))                 # each pair once
    assert all(s < d for s, d in pairs)                   # i < j, no self pairs
    verified = {(r.src, r.dst, r.distance) for r in H.lsh_pairs(df, 4, pos, t).collect()}
    assert verified <= brute(fps, t)                      # LSH finds a subset of the exact pairs
    # brute force over the same buckets
    keys = {}
    for i, v in enumerate(fps):
        bitsv = [(v >> (bits - 1 - p)) & 1 for p in range(bits)]
        for ti, ps in enumerate(pos):
            keys.setdefault((ti, tuple(bitsv[p] for p in ps)), []).append(i)
    expect = {(a, b) for m in keys.values() for x, a in enumerate(m) for b in m[x + 1:]}
    assert set(pairs) == expect
    est = H.lsh_estimate(H.lsh_buckets(df, 4, pos)).first()["estimated_pairs"]
    assert est >= len(pairs)


def test_identical_hashes_collide_and_collapse(spark):
    v = to_words(random.Random(1).getrandbits(256), 256)
    df = spark.createDataFrame([(1, v), (2, v), (3, v), (4, None)], "id long, fp array<long>")
    reps, copies = H.collapse(df)
    assert [r.rep for r in reps.collect()] == [1]
    assert sorted((r.id, r.rep) for r in copies.collect()) == [(2, 1), (3, 1)]
    b = H.lsh_buckets(df.select(F.col("id").alias("rep"), "fp").where("fp is not null"), 4,
                      H.lsh_positions(5, 8, 256))
    per = b.groupBy("table_idx").agg(F.countDistinct("bucket_key").alias("k")).collect()
    assert all(r.k == 1 for r in per)


def test_lsh_params_and_cost():
    assert H.lsh_params(1000) == (15, 20)
    assert H.lsh_params(20_000) == (18, 18)
    assert H.lsh_params(100_000) == (20, 16)
    assert H.lsh_params(1_000_000) == (25, 14)
    assert H.lsh_positions(3, 4, 256, seed=42) == H.lsh_positions(3, 4, 256, seed=42)
    assert all(p == sorted(p) and len(set(p)) == 4 for p in H.lsh_positions(3, 4, 256))


def test_lsh_cost_columns(spark):
    sizes = spark.createDataFrame([("a", n) for n in (0, 1, 1000, 10_000, 100_000, 650_000)],
                                  "collection string, n long")
    rows = H.lsh_cost_columns(H.lsh_param_columns(sizes)).collect()
    for r in rows:
        assert 0.0 <= r.estimated_reduction <= 1.0
        assert r.brute_force_comparisons == r.n * (r.n - 1) // 2


def test_threshold_validation():
    assert H.validate_threshold(10) == 10
    for bad in (-1, 300, 2.5, True, "10"):
        with pytest.raises(ValueError):
            H.validate_threshold(bad)


def test_strategy_chooser():
    for n, bits, t in [(100, 256, 10), (10 ** 8, 256, 32), (10 ** 6, 64, 18), (10 ** 9, 256, 60)]:
        assert H.choose_strategy(n, bits, t).kind == "bands"      # exact at every size
    assert H.choose_strategy(100, 256, 10, use_lsh=True).kind == "lsh"
    s = H.choose_strategy(10 ** 8, 256, 10, use_lsh=True, lsh_tables_bits=(15, 20))
    assert (s.kind, s.tables, s.bits_per_table) == ("lsh", 15, 20)
    with pytest.raises(ValueError):
        H.choose_strategy(10 ** 6, 64, 62, use_lsh=True, target_recall=0.9999999)


def test_probe(spark):
    bits = 256
    fps = random_fps(50, bits, seed=3)
    index = frame(spark, fps, bits)
    probes = spark.createDataFrame([(100, to_words(fps[5], bits)), (101, to_words(fps[9], bits))],
                                   "rep long, fp array<long>")
    got = {(r.probe, r.id) for r in H.lsh_probe(probes, index, 4, H.lsh_positions(10, 12, bits)).collect()}
    assert (100, 5) in got and (101, 9) in got


def test_recall_matches_published_table():
    # recall for one pair at distance d, 256 bits (positions sampled without replacement)
    assert round(H.lsh_recall(15, 20, 256, 10), 4) == 0.9998
    assert round(H.lsh_recall(15, 20, 256, 32), 3) == 0.616
    assert round(H.lsh_recall(25, 14, 256, 32), 3) == 0.981
    assert round(H.lsh_recall(20, 16, 256, 64), 3) == 0.157


def test_solved_params_reach_target():
    for n, t in [(10_000, 10), (1_000_000, 20), (10 ** 9, 32)]:
        L, k = H.solve_lsh_params(n, t, 256, 0.99)
        assert H.lsh_recall(L, k, 256, t) >= 0.99
    s = H.choose_strategy(10 ** 9, 256, 60, use_lsh=True)
    assert s.kind == "lsh" and H.lsh_recall(s.tables, s.bits_per_table, 256, 60) >= 0.99
