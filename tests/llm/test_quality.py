import re
from collections import Counter

from neardup.llm import quality

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string"


def base(text):
    t = text or ""
    words = SPACES.findall(t)
    lines = [x for x in t.split("\n") if SPACES.search(x)]
    found = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if found[tuple(words[i:i + 8])] > 1 for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


TEXTS = [None, "", " \n\t", "one", "the cat and the dog sat in the sun\n" * 3, " nbsp is no space here",
         "# | $ *" * 10, " ".join(f"w{i % 11}" for i in range(60)), "x " * 40, "a b c d e f g h " * 2 + "i j k",
         "The and of to in is that for on with as by at from it be this are was " * 3 + "end 😀 é",
         " ".join(f"long{i}" for i in range(30000)), "line\r\nline\r\nother\n\nline\r"]


def test_measures_are_those_of_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "x", None)]
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).select("doc_id", *quality.BASE, "base_failed", "kept").collect()
    assert len(got) == len(rows)
    want = sorted(((i, *base(t)) for i, t, _ in rows), key=str)
    assert sorted((tuple(r)[:-1] for r in got), key=str) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_rules_reject_symbols_and_keep_prose(spark):
    prose = "the house of the old man was on a hill and it was seen from all of the town by day and by night"
    rows = [(1, prose, "own"), (2, " ".join(w + "###" for w in prose.split()), "own"), (3, None, "own"),
            (4, " | ".join(prose.split()), "own")]
    kept = quality.keep_good(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert [tuple(r) for r in kept.collect()] == [rows[0]]


def test_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_projection_without_python_or_shuffle(spark):
    plan = quality.quality_rules(spark.createDataFrame([(1, "x", "y")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
