import corpus_pipeline
from neardup.llm.queries import QUERIES, SQL

PROSE = ("the house of the {0} was on a hill and it was seen from all of the {1} by day and by night, for the {2} is "
         "not as old as that of his brother who was there with us in the last {3} of the war")


def test_stages_take_effect(spark, scratch):
    fill = [["king", "town", "man", "year"], ["miller", "valley", "boy", "week"], ["smith", "village", "girl", "spring"]]
    good = [PROSE.format(*f) + f" number{i} " + " ".join(f"w{i}x{k}" for k in range(60)) for i, f in enumerate(fill)]
    item = "Which of these rivers flows through the old capital of the northern province and into the sea?"
    docs = [(1, good[0], "en", "a"), (2, good[1] + "\n" + "of all of the lines of the day this is in every text of it", "en", "a"),
            (3, good[2] + "\n" + "of all of the lines of the day this is in every text of it", "en", "a"),
            (4, "%%% ### |||", "en", "b"), (5, good[0].replace("number0", "number9"), "en", "b"),
            (6, good[1][:150] + " other words than before are in this one and that is it\n" + item, "en", "b"), (7, None, None, None)]
    rows = [(d, t, g, s, len(t or "")) for d, t, g, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(scratch + "/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(scratch + "/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, scratch).collect()}
    assert set(got) == {1, 2, 3}
    assert all(r.same and len(r.ids) == r.n_ids > 0 for r in got.values())
    assert got[3].n_ids < got[2].n_ids


def test_empty_tables(spark, scratch):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(scratch + "/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(scratch + "/benchmark.parquet")
    assert corpus_pipeline.run(spark, scratch).count() == 0


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
