import hashlib
import random
import zlib

import pytest

from neardup.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, place int"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, path of (before, after) of each node)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(nodes)):
        p = []
        for level in levels[:-1]:
            first = i // 16 * 16
            p.append(("".join(level[first:i]), "".join(level[i + 1:first + 16])))
            i //= 16
        paths.append(p)
    return levels[-1][0] if nodes else None, paths


def brute(rows, lowered=lambda r: False):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for s in order}
    root, tops = tree([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, p in zip(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), subs[s][1]):
            claimed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if lowered(r) and r[4] is not None else r
            x = leaf(claimed)
            for before, after in p + top:
                x = H(before + x + after)
            out.append((r[0], leaf(r), subs[s][0], root, "".join(b + a for b, a in p + top), x, x == root))
    return sorted(out, key=str)


def rows_of(n, sources, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.34 else rng.choice(sources)
        text = rng.choice([None, "", "Some TEXT %d" % rng.randrange(50), "é" * rng.randrange(30), "lower only"])
        rows.append((rng.choice([i, i, i, None, 7]), source, rng.choice(["en", None]), rng.choice([None, i, 0]), text))
    return rows


def found(spark, rows, tamper=False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    claimed = None
    if tamper:
        low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        claimed = {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, low).otherwise(F.col("text"))}
    out = merkle.manifest(df, claimed=claimed)
    return sorted(map(tuple, out.collect()), key=str)


def is_tampered(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0


@pytest.mark.parametrize("n,sources", [(1, ["a"]), (17, ["a"]), (300, [None, "", "a", "é", "z"]), (700, [f"s{i}" for i in range(40)])])
def test_equals_brute_force(spark, n, sources):
    rows = rows_of(n, sources)
    rows += rows[:5]
    want = brute(rows, is_tampered)
    assert found(spark, rows, tamper=True) == want
    if n > 100:
        assert any(not w[-1] for w in want) and any(w[-1] for w in want)


def test_several_superblocks(spark, monkeypatch):
    """Trees of several superblocks, over the sources too: small superblocks."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "SPAN", 16)
    rows = rows_of(900, [f"s{i}" for i in range(20)], seed=8)
    assert found(spark, rows, tamper=True) == brute(rows, is_tampered)


def test_one_large_source(spark):
    rows = [(i, "only", None, i, f"Text {i}") for i in range(merkle.SPAN * 2 + 5)]
    got = found(spark, rows, tamper=True)
    assert got == brute(rows, is_tampered)


def test_empty_and_untampered(spark):
    assert found(spark, []) == []
    got = found(spark, rows_of(50, ["a", "b"]))
    assert len(got) == 50 and all(r[-1] for r in got)
