import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neardup.operators import buckets as B, hamming as H
from test_hamming import brute, frame, random_fps
from test_pigeonhole import skewed_fps


@pytest.mark.parametrize("make,bits,radii", [(skewed_fps, 64, (3, -1, 2, 0)), (random_fps, 64, (-1, 2, 2, 2)), (skewed_fps, 256, (1, 1, 0, 2))])
def test_full_buckets_are_cut_into_tiles(spark, monkeypatch, make, bits, radii):
    """Buckets of a few values hold most rows: every pair is found once, in tiles of some rows, also across groups only."""
    monkeypatch.setattr(H, "OWN_ROWS", 7)
    monkeypatch.setattr(H, "GUEST_ROWS", 16)
    fps = list(dict.fromkeys(make(90, bits, seed=bits)))
    df = frame(spark, fps, bits)
    t = sum(r + 1 for r in radii) - 1
    ends = [0, 3, 7, 12, 18]
    plan = H.BandPlan(bits, t, tuple(zip(ends, ends[1:])), max(radii), 0, 0.0, radii)
    got = [(r.src, r.dst, r.distance) for r in H.band_pairs(df, bits // 64, plan).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(fps, t)
    comp = df.select(F.col("rep").alias("id"), (F.col("rep") % 3).alias("component"))
    of = dict(map(tuple, comp.collect()))
    across = {(r.src, r.dst, r.distance) for r in H.band_pairs(df, bits // 64, plan, comp=comp).collect()}
    assert across == {p for p in brute(fps, t) if of[p[0]] != of[p[1]]}


def test_tiles_that_share_a_hash_are_parted():
    """Two tiles under one hash, their rows mixed, dealt in batches of three rows."""
    rng = np.random.default_rng(5)
    n = 40
    key, right = rng.integers(0, 2, n), rng.integers(0, 2, n)
    words = rng.integers(0, 8, n)
    order = np.argsort(right, kind="stable")
    table = pa.table({"id": pa.array(np.arange(n)[order]), "w0": pa.array(words[order]), "band": pa.array(np.zeros(n, np.int32)),
                      "key": pa.array(key[order]), "low": pa.array(np.zeros(n, np.int32)), "high": pa.array(np.zeros(n, np.int32)),
                      "place": pa.array(2 * 77 + right[order])})
    compare = B.near_pairs(1, 1, [(0, [0], 0)], False)
    got = [tuple(sorted(p)) for b in compare(iter(table.to_batches(max_chunksize=3))) for p in zip(b["x"].to_pylist(), b["y"].to_pylist())]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if key[a] == key[b] and not (right[a] and right[b])
            and int(words[a] ^ words[b]).bit_count() <= 1}
    assert len(got) == len(set(got)) and set(got) == want


def components_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("make,bits,radii", [(skewed_fps, 64, (3, -1, 2, 0)), (random_fps, 64, (-1, 2, 2, 2)), (skewed_fps, 256, (1, 1, 0, 2))])
@pytest.mark.parametrize("tile_rows", [(7, 16), (16_384, 65_536)])
def test_links_connect_what_pairs_connect(spark, monkeypatch, make, bits, radii, tile_rows):
    """Groups sought first in tiles of a few rows, and cut buckets: the links' components are those of all pairs."""
    monkeypatch.setattr(H, "OWN_ROWS", tile_rows[0])
    monkeypatch.setattr(H, "GUEST_ROWS", tile_rows[1])
    fps = list(dict.fromkeys(make(90, bits, seed=bits)))
    t = sum(r + 1 for r in radii) - 1
    ends = [0, 3, 7, 12, 18]
    plan = H.BandPlan(bits, t, tuple(zip(ends, ends[1:])), max(radii), 0, 0.0, radii)
    got = [tuple(r) for r in H.band_links(frame(spark, fps, bits), bits // 64, plan).collect()]
    pairs = [(a, b) for a, b, _ in brute(fps, t)]
    assert set(got) and all(a < b for a, b in got)
    assert components_of(len(fps), got) == components_of(len(fps), pairs)


@pytest.mark.parametrize("right_side", [False, True])
def test_groups_of_a_tile_are_not_compared_again(monkeypatch, right_side):
    """A tile of two clusters, joined by one row, and others: few links, the same components."""
    monkeypatch.setattr(B, "LEADERS_FROM", 50)
    monkeypatch.setattr(B, "LEADERS", 12)
    monkeypatch.setattr(B, "GROUP", 8)
    monkeypatch.setattr(B, "ALONE", 16)
    rng = np.random.default_rng(3)
    n, t = 400, 6
    fps = [int(x) for x in rng.integers(0, 2**63, n)]
    for start, centre in ((0, 0x5555), (150, 0x5555 ^ 0xFFF << 20)):
        for i in range(start, start + 130):
            fps[i] = centre
            for p in rng.integers(0, 64, 3):
                fps[i] ^= 1 << int(p)
    fps[390] = 0x5555 ^ 0x3F << 20
    at = rng.permutation(n)
    right = np.sort(rng.integers(0, 2, n)) if right_side else np.zeros(n, np.int64)
    words = np.array([fps[i] for i in at], dtype=np.uint64).view(np.int64)
    zeros = np.zeros(n, np.int32)
    table = pa.table({"id": pa.array(at), "w0": pa.array(words), "band": pa.array(zeros), "key": pa.array(np.zeros(n, np.int64)),
                      "low": pa.array(zeros), "high": pa.array(zeros + 1 if right_side else zeros), "place": pa.array(2 * 5 + right)})
    got = [(x, y) for b in B.near_links(1, t)(iter(table.to_batches(max_chunksize=64))) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist())]
    side = dict(zip(at.tolist(), right.tolist()))
    pairs = [(a, b) for a, b, _ in brute(fps, t) if not right_side or side[a] != side[b]]
    assert components_of(n, got) == components_of(n, pairs)
    assert len(got) < n < len(pairs)
