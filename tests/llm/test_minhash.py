import random

import numpy as np

from neardup.llm import minhash
from neardup.llm.bytewords import Hasher, word_hashes

SCHEMA = "doc_id long, text string, keys string"


def sets(text, k):
    w = (text or "").encode().lower().split()
    if len(w) >= k:
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def brute(rows, k, percent):
    """(doc_id, size, component) of each row, groups by all pairs."""
    found = [sets(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            common = len(found[i] & found[j])
            if common and 100 * common >= percent * len(found[i] | found[j]):
                root[top(i)] = top(j)
    ids = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return sorted(((d, len(found[i]), ids.get(top(i), d) if found[i] else d) for i, (d, *_) in enumerate(rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, None, "x"), (1001, "", "x"), (1002, " \n", "x"), (1003, "one", "x"), (1004, "ONE", "x"), (1005, "one two", "x"),
            (None, "one two", "x"), (1006, "a b c d", "x")]
    for g in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([6, 30, 200]))]
        rows.append((g * 50, " ".join(text), "x"))
        for c in range(rng.randint(0, 8)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((g * 50 + c + 1, " ".join(copy), "x"))
            if rng.random() < 0.4:
                text = copy      # chains: the ends of a group need not be alike
    rows += rows[20:23]
    rng.shuffle(rows)
    return rows


def test_signature_is_the_plain_walk():
    def walk(elements, m):
        out = [None] * m
        for e in elements.tolist():
            p = list(range(m))
            for j in range(m):
                x = int(minhash.mix(np.array([(e + (j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)], dtype=np.uint64))[0])
                k = j + (((x & 0xFFFFFFFF) * (m - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                rank = (j << 32) | (x >> 32)
                out[p[j]] = rank if out[p[j]] is None else min(out[p[j]], rank)
        return out
    rng = np.random.default_rng(3)
    some = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 2, 5, 40, 300)]
    got = minhash.superminhash(some, 30)
    assert [r.tolist() for r in got] == [walk(s, 30) for s in some]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:900], rng.integers(0, 1 << 64, 100, dtype=np.uint64)]))
    x = minhash.superminhash([a, b], 240)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x[0] == x[1]).mean() - true) < 0.1


def test_words_across_chunks(monkeypatch):
    from neardup.llm import bytewords
    rng = random.Random(2)
    data = [" ".join("x" * rng.randint(1, 9) + str(rng.random()) for _ in range(n)).encode() for n in (0, 1, 500, 3, 2000)]
    want, counts = word_hashes(data, Hasher())
    monkeypatch.setattr(bytewords, "CHUNK", 700)
    got, again = word_hashes(data, Hasher())
    assert (want == got).all() and (counts == again).all() and counts.tolist() == [0, 1, 500, 3, 2000]


def test_groups_are_those_of_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = minhash.near_duplicates(df, shingle=3, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_that_leaders_do_not_settle(spark):
    """A bucket's leader is unlike some members that are like each other."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):     # each differs from its neighbours in two words, from the others in more
        rows.append((i, " ".join([f"v{j}" if j < 2 * i else w for j, w in enumerate(base)]), "x"))
    rows += [(100 + i, " ".join([f"u{i}{j}" if j < 45 else w for j, w in enumerate(base)]), "x") for i in range(10)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=3, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 85)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, "a"), (3, text + " more", "b"), (3, text + " more", "b"), (9, "alone " + text[::-1], "c"), (8, None, "d"), (8, None, "d")]
    got = minhash.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "keys"]
    assert sorted((r.doc_id for r in got.collect())) == [3, 8, 8, 9]
    assert minhash.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0


def test_prefix_pairs_hold_all_like_sets(spark):
    """Every pair at the similarity and across components is among the pairs, for a hub element and ties too."""
    from neardup.llm.linking import prefix_pairs
    rng = random.Random(12)
    for percent in (60, 80, 85, 100):
        found = []
        for _ in range(25):
            base = set(rng.sample(range(500), rng.choice([1, 2, 7, 20, 40]))) | ({1000} if rng.random() < 0.5 else set())
            found.append(base)
            for _ in range(3):
                copy = set(base)
                for x in rng.sample(sorted(base), min(len(base) - 1, rng.randint(0, 3))):
                    copy.discard(x)
                copy |= set(rng.sample(range(500), rng.randint(0, 2)))
                found.append(copy)
        components = [rng.randrange(30) for _ in found]
        elements = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(found)], "node long, elements array<long>")
        nodes = spark.createDataFrame(list(enumerate(components)), "node long, component long")
        got = [(r.a, r.b) for r in prefix_pairs(elements, nodes, percent).collect()]
        want = {(i, j) for i in range(len(found)) for j in range(i + 1, len(found)) if components[i] != components[j]
                and 100 * len(found[i] & found[j]) >= percent * len(found[i] | found[j])}
        assert len(got) == len(set(got)) and want <= set(got) and want
        assert all(components[a] != components[b] for a, b in got)
        assert len(got) < 0.3 * len(found) ** 2 / 2
