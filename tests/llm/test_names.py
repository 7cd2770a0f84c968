"""Columns of the input whose names look like the operators' own."""
import os
import subprocess
import sys

from neardup.llm import decontamination, language_id, line_dedup, minhash, quality, sentencepiece_codec

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
EXTRA = ["_file", "_row", "_text", "_gone", "_ids", "_id", "key", "node", "component", "line", "batch"]
GOOD = "the house by the river is old and the people of the town like to walk there in the evening when it is warm"


def docs(spark, scratch):
    rows = [(i, f"{GOOD} {'again ' * i}\nshared line that is in each of the documents here", "en", "s", 10, *EXTRA) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    path = scratch + "/docs"
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def held(df):
    rows = df.collect()
    assert rows and all([r[c] for c in EXTRA] == EXTRA for r in rows)
    return rows


def test_columns_are_kept(spark, scratch):
    given = docs(spark, scratch)
    benchmark = spark.createDataFrame([(1, "what is the distance between the two towns on the old map", "x")], "item_id long, text string, _text string")
    held(quality.keep_good(given))
    held(line_dedup.drop_repeated_lines(given))
    held(minhash.keep_first(given))
    held(decontamination.without_leaks(given, benchmark))
    held(sentencepiece_codec.round_trip(given, "piece_bpe_32k.model"))
    coded = sentencepiece_codec.encode(given, "piece_bpe_32k.model")
    rows = held(sentencepiece_codec.decode(coded, "piece_bpe_32k.model"))
    assert all(r.decoded == r.text for r in rows)


def test_letters_are_unicodes():
    assert not any(map(language_id.has_letter, ["", "½ ² 12", "٣ ①", "_ _", "Ⅷ"]))
    assert all(map(language_id.has_letter, ["½ a", "é", "中", "ª"]))


def test_numbers_have_no_language(spark):
    rows = [(i, w, g) for i, (w, g) in enumerate([("the house of the people", "en"), ("les gens de la maison", "fr")] * 20)] + [(99, "½ ² 12", "fr")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in got}[99] == "und"


def test_workers_without_the_package(scratch):
    """The driver knows the package by its path alone; workers can't import it."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from neardup.llm import language_id
def probe(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("neardup") is not None] * b.num_rows)], names=["has"])
assert not any(r.has for r in spark.range(4).mapInArrow(probe, "has boolean").collect())
rows = [(i, t, g) for i, (t, g) in enumerate([("the house of the people", "en"), ("les gens de la maison", "fr")] * 20)]
got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
assert {{r.lang_pred for r in got}} == {{"en", "fr"}}
print("identified", len(got))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=scratch, env=env, capture_output=True, text=True, timeout=240)
    assert "identified 40" in done.stdout, done.stderr[-2000:]
