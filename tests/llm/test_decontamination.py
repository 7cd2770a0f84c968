import pytest

from neardup.llm import decontamination as D

DOCS = "doc_id long, text string, item_id string, hash int"
ITEM = "Last week Anna bought 5 apples and 3 pears, and Bob gave her 12 plums. How many fruits does she have after 2 days?"


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "own", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.verbatim) for r in D.leaks(d, b, **kw).collect())


def test_copies_and_other_parameters_are_found_and_clean_texts_are_not(spark):
    other = ITEM.replace("5", "17").replace("3", "four").replace("12", "9").replace("Bob", "Igor").replace("Anna", "Eva")
    mixed = ITEM.replace("How many fruits does she have after 2 days", "How many plums were there in the end of it all")
    docs = [(1, "Some words before. " + ITEM + " And after."), (2, "x y z " + ITEM.lower().replace(" ", "\n") + " more"),
            (3, "He said so. " + other), (4, "no apples and no pears here"), (5, None), (6, ""), (7, mixed), (8, ITEM[:60]),
            (9, "word " * 300_000 + ITEM)]
    got = leaks(spark, docs + docs[:1], [(1, ITEM), (2, None), (3, ""), (1000, "seen nowhere at all in these few texts")])
    assert got == [(1, 1, True), (1, 1, True), (2, 1, True), (3, 1, False), (9, 1, True)]


def test_slots_must_agree(spark):
    item = "then we put 7 of the red ones with 7 of the blue ones and 7 of the green ones in the box"
    same = item.replace("7", "31")
    unlike = "then we put 4 of the red ones with 5 of the blue ones and 6 of the green ones in the box"
    got = leaks(spark, [(1, same), (2, unlike), (3, item)], [(1, item)])
    # in each window of document 2 the sentence fits, but 7 stands for three numbers
    assert got == [(1, 1, False), (3, 1, True)]


def test_short_items_and_empty_tables(spark):
    docs = [(1, "Just three words!"), (2, "here are just three words in a text"), (3, "three just words " * 5), (4, "just three"),
            (5, "yes"), (6, "yes it is"), (7, "no"), (8, "one of four small words"), (9, "of four small")]
    items = [(5, "just three words"), (6, "yes"), (7, "of four small words")]
    assert leaks(spark, docs, items) == [(1, 5, True), (2, 5, True), (5, 6, True), (8, 7, True)]
    assert leaks(spark, [], [(1, ITEM)]) == []
    assert leaks(spark, [(1, ITEM)], []) == []


def test_clean_rows_keep_their_columns(spark):
    rows = [(1, "clean " * 10, "own", 1), (2, "x " + ITEM, "own", 2), (3, None, "own", 3), (3, None, "own", 3)]
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = D.without_leaks(spark.createDataFrame(rows, DOCS), b)
    assert got.columns == ["doc_id", "text", "item_id", "hash"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


@pytest.mark.parametrize("chunk", [60, 1 << 21])
def test_words_do_not_depend_on_parts(monkeypatch, chunk):
    text = (ITEM + " Dr. Élan Vital said: Été!\n" * 3 + "a|b don't # 5kg").encode()
    whole = D.Canonical().words(text)
    monkeypatch.setattr(D, "CHUNK", chunk)
    parts = D.Canonical().words(text)
    assert all((a == b).all() for a, b in zip(whole, parts))
    words = [text[a:b].decode() for a, b in zip(whole[2], whole[3])]
    kinds = dict(zip(words, whole[1].tolist()))
    assert kinds["Anna"] == D.NAME and kinds["Last"] == D.PLAIN and kinds["12"] == D.NUMBER and kinds["days?"] == D.UNIT
    assert "#" not in words


def test_changed_copies_and_parts_are_found(spark):
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    short, middle, long = words[:10], words[10:30], words
    one = [*short[:5], "other", *short[6:]]
    four = [w if k % 5 != 3 else "other" for k, w in enumerate(middle)]
    less = [w for k, w in enumerate(middle) if k % 6 != 2]
    items = [(1, " ".join(short)), (2, " ".join(middle)), (3, " ".join(long))]
    docs = [(1, "some text " * 9 + " ".join(one) + " and so on"), (2, "x y " + " ".join(four)), (3, "a b " + " ".join(less) + " c d"),
            (4, "k l m " + " ".join(long[30:]) + " k l m"), (5, " ".join(long[40:50])), (6, " ".join(short[:5])),
            (7, " ".join(w if k % 3 else "other" for k, w in enumerate(middle)))]
    got = [(d, i) for d, i, _ in leaks(spark, docs, items)]
    assert got == [(1, 1), (2, 2), (3, 2), (4, 3)]


def test_items_dense_in_slots_are_found_with_other_parameters(spark):
    rate = "a car drives 60 miles in 2 hours and 90 miles in 3 hours so how far does it go"
    sums = "what is 12 plus 7 minus 5 times 4 plus 31 minus 6 in all"
    docs = [(1, "x y " + rate.replace("60", "80").replace("2", "4").replace("90", "70").replace("3", "5") + " z"),
            (2, "what is 15 plus 8 minus 9 times 2 plus 64 minus 3 in all"),
            (3, "12 miles in 3 hours and 40 miles in 7 hours are two facts")]
    assert leaks(spark, docs, [(1, rate), (2, sums)]) == [(1, 1, False), (2, 2, False)]


def test_template_windows_go_on_over_slots():
    import numpy as np
    words = D.Canonical().words(b"go 1 2 3 4 5 far and away")
    places, _, template, lengths = D.windows(words[0], words[1], 5)
    own = {int(p): int(k) for p, k, t in zip(places, lengths, template) if t}
    assert own == {0: 8, 1: 8, 2: 7, 3: 6, 4: 5} and places[~template].tolist() == list(range(5))
    assert (np.diff(lengths[~template]) == 0).all()


def test_items_of_slots_with_other_values(spark):
    sums = "compute the sum 3 4 5 6 7 8 9 10 11 12"
    listed = "add up the following 14 25 36 47 58 69 71 82 and stop"
    other = sums.replace("3 4 5 6 7 8 9 10 11 12", "21 34 55 89 13 77 64 90 15 18")
    changed = "add up the numbers 91 17 22 63 54 48 37 26 and stop"
    docs = [(1, "now " + other + " please"), (2, "x " + changed + " y"), (3, "compute the sum 3 4 and go"), (4, "add up the following 14 things")]
    assert leaks(spark, docs, [(1, sums), (2, listed)]) == [(1, 1, False), (2, 2, False)]


def test_a_document_with_many_items(spark):
    """A whole benchmark with a word of each item changed: (document, item) rows, all found."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600)]
    items = [(k, " ".join(words[20 * k:20 * k + 20])) for k in range(30)]
    text = " . ".join(t.replace(t.split()[9], "changed") for _, t in items)
    got = leaks(spark, [(1, text), (2, "nothing of it")], items)
    assert [(d, i) for d, i, _ in got] == [(1, k) for k in range(30)]


def test_windows_are_looked_for_wherever_they_can_match():
    """Each window of a text that is also an item's window lies where ``may_have_windows`` says yes, by brute force."""
    import random

    import numpy as np
    rng = random.Random(4)
    canonical, vocabulary = D.Canonical(), ["go", "far", "and", "away", "now", "1", "2", "33", "two", "miles"]
    for _ in range(400):
        item = " ".join(rng.choices(vocabulary, k=rng.randint(5, 14)))
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 8)) + item.split()[rng.randint(0, 4):] + rng.choices(vocabulary, k=rng.randint(0, 8)))
        (h1, k1, *_), (h2, k2, *_) = canonical.words(item.encode()), canonical.words(text.encode())
        if len(h2) < 5:
            continue
        match = np.isin(D.windows(h2, k2, 5)[1], D.windows(h1, k1, 5)[1]).any()
        at, runs = D.seeds(h2, k2)
        if match:
            assert D.may_have_windows(k2, at[np.isin(runs, D.seeds(h1, k1)[1])], 5)
    none = np.empty(0, dtype=np.int64)
    assert not D.may_have_windows(np.zeros(30, dtype=np.int64), none, 5)
