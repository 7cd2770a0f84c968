"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the form each goes back to.

Words are the lower-cased runs of letters of ``min_length`` code points or more that occur
``min_count`` times or more. Two words are near if one inserted, deleted or replaced code
point turns one into the other.

Candidates: the shorter word (either one, if equally long) contributes two disjoint chunks, its
halves; the other one its positional grams of these lengths. One edit leaves one of the chunks
whole, and moves it by one place at most: the first half, if whole, stands at its place, the
second one at its place or, in a longer word, one further. Only the grams that can meet a chunk
within this shift are written; the key holds the place, so the join is within shift one. What
is found is verified by the edit distance.

A key that many words share (a frequent beginning) is refined instead of listing its pairs: the
edit is outside the shared chunk, so of the rest again one half is whole. The words of such a
key get two longer keys (the chunk with one half of the rest), and so on until the keys are small or
the rest is one code point, where only as many words as there are letters can meet. Nothing is
capped: every near pair shares a key at each step.

A word's form is its most frequent near word, if that occurs ``ratio`` times as often or more; the
root follows the forms to the last one, by pointer doubling.

Defined cases: null and blank texts have no words; a null doc_id is empty in the sample's hash;
repeated rows count each; an empty table gives an empty result; other columns are not read; a
run of any length is one word.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from neardup.llm.common import by_bytes
from neardup.session import cut_lineage, ship_by_value

ship_by_value(__name__)

LETTERS = "[a-zÀ-ÿ]"
#: Words under one key that are still compared pair by pair.
KEY_WORDS = 40
#: Distinct words a task counts before it hands its counts on, and bytes of text at once.
HELD_WORDS, SLICE_BYTES = 200_000, 1 << 21
#: One run of a document in so many loses a code point (its hash says which one).
TYPO_RATE = 199


def word_counts(docs: DataFrame, min_length: int = 6, min_count: int = 5, id_col: str = "doc_id", text: str = "text",
                typo_rate: int | None = None) -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    With ``typo_rate`` every run whose CRC-32 (of id, colon and run) it divides loses the code point at the
    hash modulo the run's length: a deterministic sample of misspellings.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text).cast("binary").alias("body"))

    def count(batches: Iterator) -> Iterator:
        import re
        import zlib
        from collections import Counter

        import pyarrow as pa
        # a run of min_length letters or more is matched from its first letter on, so whole
        runs = re.compile(f"{LETTERS}{{{min_length},}}")
        totals: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
                                              names=["word", "n"])

        for batch, first, end in by_bytes(batches, "body", SLICE_BYTES):
            names = batch.column("name").slice(first, end - first).to_pylist()
            for name, body in zip(names, batch.column("body").slice(first, end - first)):
                body = body.as_py()
                if not body:
                    continue
                # bytes.lower changes A-Z only
                found = Counter(runs.findall(body.lower().decode("utf-8", "replace")))
                if typo_rate:
                    begin = zlib.crc32(f"{name}:".encode())
                    for w in [w for w in found if zlib.crc32(w.encode(), begin) % typo_rate == 0]:
                        n, at = found.pop(w), zlib.crc32(w.encode(), begin) % len(w)
                        if len(w) > min_length:
                            short = w[:at] + w[at + 1:]
                            totals[short] += n
                totals.update(found)
                if len(totals) > HELD_WORDS:
                    yield rows()
                    totals.clear()
        if totals:
            yield rows()

    counted = source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def rest_key(word: Column, low: Column, high: Column, longer: Column, length: Column) -> Column:
    """Hash of what stands around the rest [low, high) of a word, which is ``longer`` by 0 or 1 in the longer word."""
    return F.xxhash64(length, low, high, word.substr(F.lit(1), low), word.substr(high + longer + 1, length))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (word, n, longer, length, low, high) with the rest halved: two rows with their keys for each."""
    middle = F.expr("low + (high - low) div 2")
    halves = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")),
                               F.struct(middle.alias("low"), F.col("high").alias("high"))))
    split = rows.select("word", "n", "longer", "length", halves.alias("rest")).select("word", "n", "longer", "length", "rest.*")
    return split.withColumn("key", rest_key(*map(F.col, ["word", "low", "high", "longer", "length"])))


def near_pairs(words: DataFrame, limit: int = KEY_WORDS) -> DataFrame:
    """(a, n_a, b, n_b) of all pairs of ``words`` (word, n) that are one edit apart, each pair once."""
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    # as the shorter word (or one of two equal length) and as the longer word of a pair; length is the shorter one's
    roles = sized.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer"), "size")
    rows = roles.select("word", "n", "longer", (F.col("size") - F.col("longer")).alias("length")).where(F.col("length") >= 1)
    rows = cut_lineage(keyed(rows.withColumn("low", F.lit(0)).withColumn("high", F.col("length"))))
    pairs = None
    while True:
        held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("longer").alias("least"))
        held = cut_lineage(held.where((F.col("members") > 1) & (F.col("least") == 0)).select("key", "members"))
        shared = cut_lineage(rows.join(held, "key"))
        large = (F.col("members") > limit) & (F.col("high") - F.col("low") > 1)
        small = shared.where(~large)
        left = small.where(F.col("longer") == 0).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        right = small.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
        found = left.join(right, "key").where(((F.col("longer") == 1) | (F.col("a") < F.col("b")))
                                              & (F.levenshtein("a", "b", 1) == 1))
        found = cut_lineage(found.select("a", "n_a", "b", "n_b").distinct())
        pairs = found if pairs is None else pairs.unionByName(found)
        more = shared.where(large)
        if more.isEmpty():
            return pairs.distinct()
        rows = cut_lineage(keyed(more))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that the forms lead to from each word."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = cut_lineage(at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                  F.col("further").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, id_col: str = "doc_id",
                      text: str = "text", typo_rate: int | None = None) -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n."""
    words = cut_lineage(word_counts(docs, min_length, min_count, id_col, text, typo_rate))
    pairs = cut_lineage(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    # Spark compares strings by their UTF-8 bytes, which is the order of code points
    near = cut_lineage(both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("form"))).alias("best")))
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                     F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    follows = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    judged = cut_lineage(judged.withColumn("form", F.when(follows, F.col("form"))).withColumn("form_n", F.when(follows, F.col("form_n"))))
    last = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
