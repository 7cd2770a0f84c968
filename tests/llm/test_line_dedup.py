import random
import re

import xxhash
from itertools import combinations

from neardup.llm import line_dedup

SCHEMA = "doc_id long, text string, line_no string, kept int"


def norm(line):
    return [w for w in re.split(r"[^\w]+|_+", line.lower()) if w]


def simhash(words):
    words = [w for w in words if len(w) >= 4] or words
    votes = [0] * 60
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        for k in range(60):
            votes[k] += (h >> k) & 1
    return sum(1 << k for k in range(60) if 2 * votes[k] > len(words))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(rows, min_words=5, percent=80):
    """Per line that takes part: (doc_id, line_no, kept), lines in the order given."""
    lines = [(d, n, norm(x)) for d, t, *_ in rows for n, x in enumerate((t or "").split("\n")) if len(norm(x)) >= min_words]
    text = [" ".join(w) for _, _, w in lines]
    hashes = {t: simhash(w) for t, (_, _, w) in zip(text, lines)}
    blocks = {t: {(a, b, (h >> 15 * a) & 32767, (h >> 15 * b) & 32767) for a, b in combinations(range(4), 2)} for t, h in hashes.items()}
    root = {t: t for t in hashes}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t
    for a, b in combinations(hashes, 2):
        if blocks[a] & blocks[b] and bin(hashes[a] ^ hashes[b]).count("1") <= line_dedup.MAX_BITS and distance(a.split(), b.split()) <= (100 - percent) * max(len(a.split()), len(b.split())) // 100:
            root[top(a)] = top(b)
    seen, out = set(), []
    for i in sorted(range(len(lines)), key=lambda i: (lines[i][0] is not None, lines[i][0] or 0, lines[i][1])):
        g = top(text[i])
        out.append((lines[i][0], lines[i][1], g not in seen))
        seen.add(g)
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu"]
    pool = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(30)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool)
            if rng.random() < 0.5 and line:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(["x", "", "!", ", "]) + line[at + 1:]
            lines.append(rng.choice([str, str.upper])(line))
        rows.append((d, "\n".join(lines), "own", 1))
    return rows + [(100, None, "own", 1), (101, "", "own", 1), (102, "short line\n\n--", "own", 1),
                   (103, "cat " * 9 + "\n" + "dog " * 70000, "own", 1), (104, "dog " * 70000, "own", 1)]


def test_lines_are_those_of_brute_force(spark):
    rows = corpus()
    rng = random.Random(2)
    rng.shuffle(rows)
    short = [r for r in rows if r[0] < 103]
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    have = sorted(((r.doc_id, r.line_no, r.kept) for r in got if r.doc_id < 103), key=str)
    assert have == brute(short)
    assert sorted((r.doc_id, r.line_no, r.first_doc_id, r.kept) for r in got if r.doc_id >= 103) == [
        (103, 0, 103, True), (103, 1, 103, True), (104, 0, 103, False)]


def test_dropped_lines_and_emptied_documents(spark):
    a = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, f"{a}\nkeep this short\n{a}!", "x", 1), (2, f"{a}\n--\n", "x", 2), (3, f"first\n{a.upper()}\nlast", "x", 3),
            (4, None, "x", 4), (4, None, "x", 4), (None, "only this line has these eight words here", "x", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [(1, f"{a}\nkeep this short", "x", 1), (3, "first\nlast", "x", 3), rows[3], rows[3], rows[5]], key=str)


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert line_dedup.drop_repeated_lines(df).count() == 0
    one, long = line_dedup.simhashed_lines(line_dedup.lines_of(line_dedup.scannable(df), "doc_id", "text"), 5)
    for x in (one, long):
        assert "Python" not in x._jdf.queryExecution().executedPlan().toString()


def by_edits_alone(rows, min_words=4, percent=80):
    """Per line that takes part: (doc_id, line_no, kept), of all pairs of lines."""
    lines = [(d, n, norm(x)) for d, t, *_ in rows for n, x in enumerate((t or "").split("\n")) if len(norm(x)) >= min_words]
    root = {tuple(w): tuple(w) for _, _, w in lines}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t
    for a, b in combinations(list(root), 2):
        if distance(a, b) <= (100 - percent) * max(len(a), len(b)) // 100:
            root[top(a)] = top(b)
    seen, out = set(), []
    for d, n, w in sorted(lines, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        out.append((d, n, top(tuple(w)) not in seen))
        seen.add(top(tuple(w)))
    return sorted(out, key=str)


def test_verdicts_are_those_of_edit_similarity_alone(spark):
    rng = random.Random(3)
    rows = corpus()
    for d in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([5, 6, 9, 10, 14, 20, 33, 50]))]
        other = list(words)
        for at in rng.sample(range(len(words)), len(words) // 5):
            other[at] = f"x{rng.randrange(4000)}"
        if d % 3 == 0 and len(words) >= 10:
            other = words[2:]
        rows.append((200 + d, " ".join(words) + "\n" + " ".join(other), "own", 1))
    short = [r for r in rows if r[0] not in (103, 104)]
    rng.shuffle(rows)
    got = line_dedup.line_verdicts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    have = sorted(((r.doc_id, r.line_no, r.kept) for r in got if r.doc_id not in (103, 104) and len(norm(dict((x[0], x[1]) for x in rows)[r.doc_id].split("\n")[r.line_no])) >= 4), key=str)
    assert have == by_edits_alone(short)
    assert all(kept == (n == 0) for d, n, kept in have if d >= 200)
    assert sorted((r.doc_id, r.line_no, r.first_doc_id, r.kept) for r in got if r.doc_id in (103, 104)) == [
        (103, 0, 103, True), (103, 1, 103, True), (104, 0, 103, False)]


def test_short_lines_are_compared_exactly(spark):
    long = "中文没有空格的一句话也是一行"
    rows = [(1, f"Read more\n{long}\n--\nfour words of text", "x", 1), (2, f"read MORE!\n{long}。\n--\nfour words of texts", "x", 2),
            (3, "own line of five words\nread more\n\nRead", "x", 3), (4, "Read more", "x", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in line_dedup.line_verdicts(df).collect()}
    assert got == {(1, 0): (1, 0, True), (1, 1): (1, 1, True), (1, 3): (1, 3, True), (2, 0): (1, 0, False), (2, 1): (1, 1, False),
                   (2, 3): (2, 3, True), (3, 0): (3, 0, True), (3, 1): (1, 0, False), (3, 3): (3, 3, True), (4, 0): (1, 0, False)}
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert left == {1: rows[0][1], 2: "--\nfour words of texts", 3: "own line of five words\n\nRead"}


def test_lines_of_four_and_five_words_are_alike(spark):
    rows = [(1, "alpha beta gamma delta", "x"), (2, "Alpha, beta gamma delta epsilon!", "x"), (3, "alpha beta gamma", "x"),
            (4, "alpha beta gamma zeta", "x"), (5, "alpha beta delta", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = {r.doc_id: (r.first_doc_id, r.kept) for r in line_dedup.line_verdicts(df).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_majority_of_bits_is_that_of_counting(spark):
    rng = random.Random(5)
    mask = (1 << line_dedup.WIDTH) - 1
    rows = [(i, [rng.getrandbits(63) for _ in range(n)]) for i, n in enumerate([1, 2, 6, 7, 8, 15, 16, 31, 32, 63, 64, 300, 3000])]
    want = {i: sum(1 << k for k in range(line_dedup.WIDTH) if 2 * sum(w >> k & 1 for w in words) > len(words)) for i, words in rows}
    df = spark.createDataFrame(rows, "i int, words array<bigint>")
    got = {r.i: r.h & mask for r in df.select("i", line_dedup.simhash_of(df.words).alias("h")).collect()}
    assert got == want


def test_simhash_search_finds_nine_of_ten_pairs_of_edit_similarity(spark):
    """Random lines at the very limit of the similarity; each document holds one pair."""
    rng = random.Random(7)

    def word():
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 12)))
    rows = []
    for size in (5, 7, 10, 14, 20, 33, 50, 90):
        for _ in range(60):
            words = [word() for _ in range(size)]
            other = list(words)
            for at in rng.sample(range(size), size // 5):
                other[at] = word()
            rows.append((len(rows), " ".join(words) + "\n" + " ".join(other).upper(), "own", 1))
    apart = [(len(rows) + i, " ".join(word() for _ in range(20)), "own", 1) for i in range(300)]
    got = line_dedup.simhash_verdicts(spark.createDataFrame(rows + apart, SCHEMA)).collect()
    seconds = [r for r in got if r.line_no == 1]
    assert all(r.kept for r in got if r.line_no == 0)
    assert all(r.first_doc_id == r.doc_id for r in got)
    assert len(seconds) == len(rows) and sum(not r.kept for r in seconds) >= 0.9 * len(rows)


def test_simhash_search_links_only_what_edit_similarity_links(spark):
    rows = corpus(seed=9)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {(r.doc_id, r.line_no): r for r in line_dedup.line_verdicts(df).collect()}
    got = {(r.doc_id, r.line_no): r for r in line_dedup.simhash_verdicts(df).collect()}
    assert set(got) == set(want)
    gone, found = {k for k, r in want.items() if not r.kept}, {k for k, r in got.items() if not r.kept}
    assert found <= gone and len(found) >= 0.9 * len(gone)


def test_simhash_search_defined_cases(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert line_dedup.simhash_verdicts(df).count() == 0
    rows = [(None, "one two three four five", "x", 1), (1, None, "x", 1), (2, "", "x", 1), (3, "-- \n\n", "x", 1),
            (4, "one two three four five\nRead more", "x", 1), (4, "one two three four five\nRead more", "x", 1)]
    got = sorted(((r.doc_id, r.line_no, r.first_doc_id, r.kept) for r in line_dedup.simhash_verdicts(
        spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (4, 0, None, False), (4, 0, None, False), (4, 1, 4, True), (4, 1, 4, False)], key=str)
    plan = line_dedup.blocked_lines(line_dedup.lines_of(line_dedup.scannable(df), "doc_id", "text"), 4, 80)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_large_group_of_like_lines_is_one_group(spark):
    """Near copies that all differ and share their longest words: one stays, without all pairs."""
    rows = [(i, f"incomprehensibilities notwithstanding counterrevolutionary shared words of this line number n{i} end of it", "x", 1)
            for i in range(400)]
    got = line_dedup.simhash_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.doc_id for r in got if r.kept] == [0]
    assert {r.first_doc_id for r in got} == {0}


def test_simhash_search_leaves_out_no_pair_of_edit_similarity(spark):
    """Pairs at the very limit whose edits take the longest words, the SimHash's voters, too; all in one search."""
    rng = random.Random(11)
    rows = [r for r in corpus(seed=4) if r[0] not in (103, 104)]
    for d in range(300):
        size = rng.choice([4, 5, 6, 9, 10, 14, 15, 20, 33, 50, 90])
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(size)]
        other = list(words)
        longest = sorted(range(size), key=lambda i: -len(words[i]))
        for at in longest[:size // 5] if d % 2 else rng.sample(range(size), size // 5):
            other[at] = "".join(rng.choices("abcdefghij", k=rng.randint(1, 12)))
        if d % 5 == 0 and size >= 5:
            other = words[size // 5:]
        if d % 7 == 0:
            other = words + [f"new{i}" for i in range(size // 4)]
        rows.append((200 + d, " ".join(words) + "\n" + " ".join(other), "own", 1))
    have = {(d, n) for d, n, _ in by_edits_alone(rows)}
    got = line_dedup.simhash_verdicts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    found = sorted(((r.doc_id, r.line_no, r.kept) for r in got if (r.doc_id, r.line_no) in have), key=str)
    assert found == by_edits_alone(rows)


def test_rare_pairs_are_searched_in_parts(spark, scratch, monkeypatch):
    """The same verdicts from one part and from many; of the written tables only the nodes hold the lines' records."""
    spark.createDataFrame(corpus(seed=6), SCHEMA).repartition(3).write.parquet(f"{scratch}/docs")
    docs = spark.read.parquet(f"{scratch}/docs")
    at = [*line_dedup.AT, "doc_id", "first_doc_id", "first_line_no", "kept"]

    def verdicts():
        return sorted(line_dedup.simhash_verdicts(docs).select(*at).collect(), key=str)

    one, written = verdicts(), []
    cut = line_dedup.cut_lineage
    monkeypatch.setattr(line_dedup, "PART_NODES", 10)
    monkeypatch.setattr(line_dedup, "MOST_PARTS", 3)
    monkeypatch.setattr(line_dedup, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    assert verdicts() == one
    assert sum("rare" in columns or "of" in columns and "line_no" in columns for columns in written) == 1
    assert not any("ha" in columns or "p0" in columns and "key" in columns for columns in written)
    assert sum(columns == ["a", "b"] for columns in written) > line_dedup.MOST_PARTS


def test_lines_that_repeat_words_meet_by_their_longest_ones(spark, monkeypatch):
    """Common words that many lines repeat, with others of their own, bring no pair of lines to the edit distance."""
    rows = [(i, " ".join([f"ownword{i}"] * 20 + [f"other{i}"] * 20 + ["the"] * 20), "x", 1) for i in range(40)]
    tested, confirmed = [], line_dedup._confirmed
    monkeypatch.setattr(line_dedup, "_confirmed", lambda lines, nodes, pairs, percent: tested.append(pairs.count()) or confirmed(lines, nodes, pairs, percent))
    got = line_dedup.simhash_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 40 and all(r.kept for r in got)
    assert sum(tested) <= len(rows)


def test_an_edit_changes_two_parities_at_most(spark):
    rng = random.Random(13)
    rows = []
    for i in range(60):
        words = ["".join(rng.choices("abcdef", k=rng.randint(1, 14))) for _ in range(rng.choice([4, 9, 30, 200]))]
        at = rng.randrange(len(words))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:at] + [["new"], [], [words[at], "inserted"]][i % 3] + words[at + 1:]))]
    df = spark.createDataFrame(rows, "i int, text string").select("i", line_dedup._parities(line_dedup.F.transform(
        line_dedup.normalised_words(line_dedup.F.col("text")), line_dedup._packed)).alias("p"))
    of = {r.i: tuple(r.p) for r in df.collect()}
    apart = [sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(of[i], of[i + 1])) for i in range(0, 120, 2)]
    assert 0 < max(apart) <= 2
    assert len(set(of.values())) > 60
