import random

from pyspark.sql import functions as F

from neardup.operators import hamming as H
from test_hamming import brute, frame, random_fps


def hot_fps(n, bits, seed):
    """Half of all rows agree in the upper half of their bits."""
    rng = random.Random(seed)
    high = rng.getrandbits(bits // 2) << bits // 2
    return list(dict.fromkeys([high | rng.getrandbits(bits // 2) for _ in range(n // 2)] + random_fps(n // 2, bits, seed + 1)))


def test_tiled_pairs_equal_untiled_ones(spark):
    fps = hot_fps(160, 64, 3)
    df = frame(spark, fps, 64)
    pos = [list(range(0, 12)), [3, 9, 20, 40, 60]]
    whole = sorted(tuple(r) for r in H.lsh_pairs(df, 1, pos, None).collect())
    for rows in (1, 7, 50):
        got = [tuple(r) for r in H.lsh_pairs(df, 1, pos, None, tile_rows=rows).collect()]
        assert len(got) == len(set(got)) and sorted(got) == whole
    near = {tuple(r) for r in H.lsh_pairs(df, 1, pos, 20, tile_rows=10).collect()}
    assert near == {p for p in whole if p[2] <= 20} <= brute(fps, 20)


def test_a_hot_bucket_spreads_over_tiles(spark):
    """One bucket with half of all rows: no (bucket, tile) key has more rows than two blocks hold."""
    fps = hot_fps(2000, 64, 5)
    index = frame(spark, fps, 64).select(F.col("rep").alias("id"), F.shiftrightunsigned(F.col("fp")[0], 50).alias("key"))
    tiles = H.bucket_tiles(index, ["key"], 100)
    assert tiles.count() == 1
    sides = [H.tiled(index, "id", ["key"], tiles, left) for left in (True, False)]
    largest = [s.groupBy("key", "low", "high").count().agg(F.max("count")).first()[0] for s in sides]
    assert max(largest) <= 200                      # blocks of about 100 by hash
    keys = sides[0].groupBy("key", "low", "high").count().count()
    k = tiles.first().blocks
    assert keys >= k * (k + 1) // 2
    assert H.bucket_tiles(index, ["key"], 5000) is None
