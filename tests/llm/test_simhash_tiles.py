import random

import numpy as np
import pytest
import xxhash

from neardup.llm import simhash_tiles

SCHEMA = "doc_id long, text string, print string, component string"


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, radius=3):
    """Smallest index of each print's group, by all pairs."""
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE two"), (905, "one  two"), (None, "one two"), (None, None)]
    for g in range(15):
        text = [rng.choice(words) for _ in range(rng.choice([8, 80, 400]))]
        rows.append((g * 20, " ".join(text)))
        for c in range(rng.randint(0, 6)):
            copy = list(text)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((g * 20 + c + 1, "\n".join(copy)))
    rows += rows[10:14]
    return rows


def test_fingerprints_are_the_plain_ones():
    for _, t in corpus():
        assert simhash_tiles.fingerprint(None if t is None else t.encode(), 3) == plain(t)
    long = " ".join(random.Random(1).choices(["Ab", "cdé", "x", "y" * 40], k=3000))
    assert simhash_tiles.fingerprint(long.encode(), 3) == plain(long)


@pytest.mark.parametrize("limit", [5, 17, 64])
def test_pieces_give_each_run_once(limit):
    rng = random.Random(limit)
    for _ in range(30):
        text = "".join(rng.choice([" ", "\n", "a", "bc", "d" * 30]) for _ in range(rng.randrange(1, 120))).encode()
        words = text.split()
        runs = []
        for piece in simhash_tiles.word_lists(text, 3, limit):
            runs += [piece[i:i + 3] for i in range(len(piece) - 2)]
        assert runs == [words[i:i + 3] for i in range(len(words) - 2)]


def test_groups_equal_all_pairs(spark):
    rows = corpus()
    got = simhash_tiles.simhash_groups(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), shingle=3).collect()
    prints = [plain(t) for _, t in rows]
    at = brute(prints)
    first = {}
    for (d, _), g in zip(rows, at):
        if d is not None:
            first[g] = min(first.get(g, d), d)
    want = sorted(((d, p, first.get(g)) for (d, _), p, g in zip(rows, prints, at)), key=str)
    assert sorted(((r.doc_id, r.print % (1 << 64), r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_links_connect_all_close_prints(spark, parts, monkeypatch):
    """Any number of parts, several blocks in a tile, a dense cluster and the radius's border."""
    monkeypatch.setattr(simhash_tiles, "BLOCK", 16)
    rng = random.Random(parts)
    values = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(10):
            x = base
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
            values.add(x)
    hub = rng.getrandbits(64)
    values |= {hub} | {hub ^ (1 << a) for a in range(64)}
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    links = simhash_tiles.links(spark.createDataFrame([(v,) for v in signed], "print long"), 3, parts).collect()
    place = {v: i for i, v in enumerate(signed)}
    assert all((values[place[r.a]] ^ values[place[r.b]]).bit_count() >= 1 for r in links)
    root = list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in links:
        a, b = sorted((top(place[r.a]), top(place[r.b])))
        root[b] = a
    assert [top(i) for i in range(len(values))] == brute(values)


def test_forest_is_linear():
    rng = np.random.default_rng(1)
    base = np.uint64(rng.integers(0, 1 << 63))
    dense = base ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))
    a, b = simhash_tiles.forest(dense, dense, True, 3)
    assert len(a) == 59 and len(set(b.tolist())) == 1
    a, b = simhash_tiles.forest(dense[:30], dense[30:], False, 3)
    assert len(a) == 59


def test_empty_table(spark):
    assert simhash_tiles.simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []
