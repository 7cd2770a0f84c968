import random
import re
import zlib
from collections import Counter

import pytest

from neardup.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"
UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, rate):
    total = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if rate and h % rate == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}
    out, forms, sides = {}, {}, {}
    for w in words:
        sides[w] = [x for x in words if near(w, x)]
        best = min(sides[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            forms[w] = best
    for w, n in words.items():
        r = w
        while r in forms:
            r = forms[r]
        out[w] = (w, forms.get(w), r, n, len(sides[w]), words.get(forms.get(w)))
    return sorted(out.values())


def corpus(seed=2):
    rng = random.Random(seed)
    stems = ["abcdef", "aabbcc", "strasse", "Éléphant", "übermaß", "aaaaaa", "internationalisation", "prefixed" * 3]
    rows = [(1, None), (2, ""), (3, "12 ; short ab"), (None, "Strasse strasse, STRASSE strasse strasse")]
    for i in range(260):
        text = []
        for _ in range(30):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1:]])
            text.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((10 + i, rng.choice([" ", ", ", "7"]).join(text)))
    rows.append((5000, "chaining " * 150 + "chainings " * 28 + "chainingss " * 5))
    return rows + rows[4:40]


@pytest.mark.parametrize("rate", [None, 7, 199])
def test_equals_brute_force(spark, rate):
    rows = corpus()
    got = spelling.spelling_variants(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), typo_rate=rate).collect()
    want = brute(rows, rate)
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want if w[1]) or rate


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_near_pairs_at_any_refinement(spark, limit):
    """Keys refined down to one code point find the same pairs as keys compared at once."""
    rng = random.Random(limit)
    words = {"".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(150)} | {"abcdef" + c for c in "ghijklmnopé"}
    words |= {c + "bcdefg" for c in "hijé"} | {"a" * k for k in range(6, 30)}
    words = sorted(words)
    got = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), limit).collect()
    pairs = [tuple(sorted((r.a, r.b))) for r in got]
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1:] if near(a, b))
    assert sorted(pairs) == sorted(tuple(sorted(p)) for p in want)


def test_roots_of_long_chains(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)]
    got = spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {r.root for r in got} == {"w040"} and len(got) == 40


def test_long_runs_and_empty_table(spark):
    long = "ab" * 30_000
    rows = [(i, long + " " + long[:-1]) for i in range(6)]
    got = spelling.spelling_variants(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert sorted(len(r.word) for r in got) == [59_999, 60_000] and all(r.n_near == 1 for r in got)
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
