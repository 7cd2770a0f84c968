import math
import random

import numpy as np
import pytest

from neardup.functions.fingerprint import DCT_SCALE, dct_basis, dct_hash, gray_levels


def plain(pixels, n, keep):
    basis = np.array([[round(math.cos(math.pi * (2 * x + 1) * u / (2 * n)) * DCT_SCALE) for x in range(n)] for u in range(n)], dtype=object)
    c = (basis @ np.array(pixels, dtype=object).reshape(n, n) @ basis.T)[:keep, :keep].reshape(-1).tolist()
    s = sorted(c)
    bits = [2 * x > s[len(s) // 2 - 1] + s[len(s) // 2] for x in c]
    return [int("".join("1" if b else "0" for b in bits[i:i + 64]), 2) for i in range(0, len(bits), 64)]


@pytest.mark.parametrize("n,keep", [(8, 8), (16, 8), (16, 16)])
def test_hash_is_the_matrix_product(spark, n, keep):
    rng = random.Random(n)
    rows = [(i, [rng.randrange(256) for _ in range(n * n)]) for i in range(20)] + [(90, [7] * (n * n)), (91, None)]
    df = spark.createDataFrame(rows, "id long, pixels array<long>")
    got = {r.id: r.fp for r in df.select("id", dct_hash("pixels", n, keep).alias("fp")).collect()}
    assert got[91] is None
    for i, p in rows[:-1]:
        assert [w % (1 << 64) for w in got[i]] == plain(p, n, keep)


def test_basis_is_near_the_cosines():
    assert dct_basis(8)[:8] == [DCT_SCALE] * 8 and len(dct_basis(8)) == 64


def test_gray_levels(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.5, 0.25]), (2, [3.0] * 4), (3, [1.0]), (4, None), (5, [1.0, None, 2.0, 3.0])],
                               "id long, v array<float>")
    got = {r.id: r.p for r in df.select("id", gray_levels("v", 2).alias("p")).collect()}
    assert got == {1: [0, 255, 127, 63], 2: [0] * 4, 3: None, 4: None, 5: None}


def test_similar_pictures_are_near(spark):
    picture = [int(127 + 100 * math.sin(x / 3) * math.cos(y / 4)) for y in range(16) for x in range(16)]
    brighter = [min(255, p + 8) for p in picture]
    noise = random.Random(3)
    other = [noise.randrange(256) for _ in picture]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([picture, brighter, other])], "id long, p array<long>")
    a, b, c = (r.fp[0] % (1 << 64) for r in df.select("id", dct_hash("p", 16, 8).alias("fp")).orderBy("id").collect())
    assert (a ^ b).bit_count() <= 6 < 16 < (a ^ c).bit_count()
