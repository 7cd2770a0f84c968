import random
import zlib

from neardup.llm import language_id as L

WORDS = {"en": "the and of house water green running people".split(), "fr": "le les des maison eau vert courir gens".split(),
         "de": "der die und haus wasser grün laufen leute".split()}
SCHEMA = "doc_id long, text string, lang string, score string"


def rows(n=300):
    rng = random.Random(1)
    return [(i, " ".join(rng.choices(WORDS[g], k=rng.randint(5, 60))), g, "x") for i, g in enumerate(random.Random(2).choices(list(WORDS), k=n))]


def test_held_out_accuracy_and_defined_cases(spark):
    odd = [(9001, None, "en", "x"), (9002, "", "en", "x"), (9003, "123 !?", "de", "x"), (None, "the house", "en", "x"),
           (9004, "les gens", None, "x"), (9004, "les gens", None, "x")]
    data = rows() + odd
    got = L.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    truth = {d: g for d, _, g, _ in data}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.lang_pred in (*WORDS, "und")
    test = [r for r in got if r.held_out and r.doc_id < 9000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.97 * len(test) > 0
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and by[9001].score == 0
    assert by[9004].lang_pred == "fr"


def test_without_labels_and_without_rows(spark):
    got = L.identify(spark.createDataFrame([(1, "some words", None, "x")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_count_every_gram(monkeypatch):
    text = L.padded("straße über häuser " * 50)
    whole = sorted(L.grams(text).tolist())
    for size in (17, 40, 1000):
        parts = []
        for at in range(0, len(text), size):
            parts += L.grams(text[at:at + size]).tolist()
            if at + size < len(text):
                n = max(L.GRAMS) - 1
                parts += L.across(text[at + size - n:at + size + n], n).tolist()
        assert sorted(parts) == whole


def test_every_labelled_language_is_learned_from(spark):
    from neardup.llm import language_id
    rows = [(10 * k + d, f"text of language {k} here", f"l{k:03d}") for k in range(120) for d in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({x[0] for x in language_id.examples(docs, "doc_id", "text", "lang")}) == 120
