"""Fuzzy line dedup: SimHash blocks, edit similarity, one line kept of each connected group.

A line is normalised to its lower-cased runs of letters and digits; lines without one
always stay. Lines of fewer than ``min_words`` runs (headings, list marks, sentences in scripts
without spaces) are like others only if their normalised lines are equal; at three words or fewer and 0.8 they
can't be like others in any other way.

``simhash_verdicts`` links lines whose edit similarity over words, 1 - distance / words of the
longer line, reaches ``percent``:

1. Each line is split once, into a record of its hash, number of words, SimHash, parities, keys and rare runs of words. Its
   longest words (a quarter of them and five, fifteen at most) vote on the SimHash.
2. Equal normalised lines (by 128 bits of hash) are one node.
3. A key is one of the voters, a place that it picks by its hash, and the block of the SimHash there; a line has those of a few voters, of
   the smallest hashes. Blocks alone would put a fixed share of all lines into each bucket; the word keeps buckets narrow. Each node is
   tested against its bucket's leader, and what is linked is one provisional group, so a bucket of near copies costs linear work.
4. The rest is found by rare runs of three neighbouring words: an edit takes three of a line's runs at most, so of two lines within the
   allowed edits each lacks ``floor(3 * (100 - percent) / 100 * words)`` of its own at most, and among one more of the rarest (those of the
   longest words; a run counts as often as it is there) of each there is a common one (prefix filter). Nodes of different groups that share
   one are tested, those of a run's largest group with the others only. No pair that reaches ``percent`` (50 or more; runs of two
   words below 67) is left out. Pairs of words are shared by chance by more and more lines as the table grows, runs of three by few.
5. Before the edit distance go pairs that can't be links: by their lengths, or because an edit changes two of the parities at
   most; in step 3 also those whose SimHashes differ in more than ``NEAR_BITS`` bits, which step 4 tests again. For the distance
   each word becomes one character by its hash, twice by different bits of it, and both must reach the similarity.
6. Of each group the first occurrence stays: smallest doc_id (null first), then
   place in the files, then line number.

``line_verdicts`` is the exact search by single words among each line's rarest ones, with the fuller buckets; it is
the yardstick of the tests. ``repeated_lines`` is the first search by SimHash, pairs of four 15-bit
blocks, which misses most pairs near ``percent``. No query uses either.

Column functions only; no user functions. Texts are fetched for the lines of candidate pairs only: by a broadcast of
their places up to ``BROADCAST_ROWS`` nodes; beyond that the lines are joined with them, which shuffles their texts.

Defined cases: null and blank texts have no lines that take part; repeated rows
are different rows, so the lines of the second one go; an empty table gives an empty
result; ``drop_repeated_lines`` keeps all columns, leaves a text without dropped
lines as it is, and drops a document whose every line with a word was dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from neardup.llm.common import ROW_ID, let, scannable, with_row_id
from neardup.llm.linking import led_buckets, link_groups, several, shared_buckets
from neardup.operators.components import connected_components
from neardup.operators.hamming import size_checked_broadcast
from neardup.session import cut_lineage

#: Of four numbers each.
BROADCAST_ROWS = 250_000
#: Two lines of fewer words can't differ in a word at a similarity of 0.8.
MIN_WORDS = 4
PERCENT = 80
#: Hash slots whose word counts order the words; a literal of that many bytes.
SLOTS = 1 << 16
PARITIES = 128
MAX_BITS = 12
VOTER = 4
BITS, BLOCK, LANE = 60, 15, 15
PER_LONG = BITS // LANE
SUMS = BITS // PER_LONG
#: Words that a lane can count, with its highest bit left for the comparison.
PART = (1 << (LANE - 1)) - 1
LANE_MASK = sum(1 << (LANE * k) for k in range(PER_LONG))
#: Bits of the SimHash that the queries use, and how many of them two like lines may differ in.
WIDTH = 56
NEAR_BITS = 22
#: Words that vote besides the longest quarter, and the most voters: what four bits count.
MORE_VOTERS, MOST_VOTERS = 4, 15
#: Every fourth of the WIDTH bits.
NIBBLES = sum(1 << k for k in range(0, WIDTH, 4))
#: Bits of a block; keys of a line, and of one of fewer than SHORT words.
KEY_BITS, KEYS = 2, 6
SHORT, SHORT_KEYS = 16, 10
#: Nodes for each part that the rare runs of words are searched in, and the most parts.
PART_NODES, MOST_PARTS = 750_000, 8
#: Longs of 64 parities each; the words of at least so many characters go to one of the first.
PARITY_WORDS = 4
PARITY_LENGTHS = [10, 7, 4]
#: Lengths of words beyond this one count as this one; seven of them fit into the bits above a hash.
LONGEST = 18
#: Digits of the vote counters, by the number of voters.
PLANES = [4, 5, 6, 7, 9, 12, 24]
AT = [*ROW_ID, "line_no"]
#: Characters that stand for words: all of one UTF-16 unit below the surrogates.
CHARACTERS = 0xD7FF
#: Characters of a code; they begin at this number, so each takes four hexadecimal digits.
CODES = 0x4000


def normalised_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^\\p{L}\\p{N}]+"), "")


def as_characters(words: Column) -> Column:
    """A text with one character for each word. Two different words share theirs once in CHARACTERS times."""
    units = F.transform(words, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(CHARACTERS)) + 1), 4, "0"))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-16BE")


def in_two_codes(words: Column) -> Column:
    """x and y: texts of one character for each word, by different bits of its hash; words that share one in x rarely do in y."""
    def text(hashes: Column, shift: int) -> Column:
        def unit(h: Column) -> Column:
            bits = F.shiftrightunsigned(h, shift) if shift else h
            return F.hex(bits.bitwiseAND(F.lit(CODES - 1)).bitwiseOR(F.lit(CODES)))
        return F.decode(F.unhex(F.array_join(F.transform(hashes, unit), "")), "UTF-16BE")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(text(h, 0).alias("x"), text(h, 32).alias("y")))


def lines_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """ROW_ID, doc_id, line_no (from 0), line."""
    rows = with_row_id(docs).select(*ROW_ID, F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"))
    return rows.select(*ROW_ID, "doc_id", F.posexplode(F.split("_text", "\n")).alias("line_no", "line"))


def _lane(k: int) -> Column:
    """Votes for bit k from the packed sums."""
    lane, s = divmod(k, SUMS)
    return F.shiftrightunsigned(F.col(f"s{s}"), LANE * lane).bitwiseAND(F.lit((1 << LANE) - 1))


def _packed_bits(n: Column) -> Column:
    """The bits with more than half of ``n`` votes, four at a time: the votes of the lane
    plus what lacks to the lane's highest bit reach it."""
    lacks = (F.lit(1 << (LANE - 1)) - F.floor(n / 2) - 1) * F.lit(LANE_MASK)
    out = F.lit(0).cast("bigint")
    for s in range(SUMS):
        reached = F.shiftrightunsigned(F.col(f"s{s}") + lacks, LANE - 1).bitwiseAND(F.lit(LANE_MASK))
        out = out.bitwiseOR(F.shiftleft(reached, s))
    return out


def simhashed_lines(lines: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """AT, doc_id, k1, k2 (hashes of the normalised line), n_words, simhash of the lines that take part.

    The first result has the lines of up to PART voters, the second the longer ones.
    """
    words = lines.withColumn("words", normalised_words(F.col("line"))).where(F.size("words") >= min_words)
    words = words.select(*AT, "doc_id", "words", F.filter("words", lambda w: F.length(w) >= VOTER).alias("long"),
                         F.array_join("words", " ").alias("norm"))
    own = ["doc_id", "k1", "k2", "n_words", "n_votes"]
    keyed = words.select(*AT, "doc_id", F.size("words").cast("bigint").alias("n_words"),
                         F.when(F.size("long") > 0, F.col("long")).otherwise(F.col("words")).alias("voters"),
                         F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"))
    keyed = keyed.withColumn("n_votes", F.size("voters").cast("bigint"))

    def voted(rows: DataFrame, keys: list[str]) -> DataFrame:
        sums = [F.sum(F.shiftrightunsigned("h", s).bitwiseAND(F.lit(LANE_MASK))).alias(f"s{s}") for s in range(SUMS)]
        return rows.groupBy(*keys).agg(*sums, *[F.max(c).alias(c) for c in own])

    short = keyed.where(F.col("n_votes") <= PART).select(*AT, *own, F.explode("voters").alias("word"))
    short = voted(short.select(*AT, *own, F.xxhash64("word").alias("h")), AT)
    one = short.select(*AT, "doc_id", "k1", "k2", "n_words", _packed_bits(F.col("n_votes")).alias("simhash"))

    parts = keyed.where(F.col("n_votes") > PART).select(*AT, *own, F.posexplode("voters").alias("p", "word"))
    parts = voted(parts.select(*AT, *own, F.floor(F.col("p") / PART).alias("part"), F.xxhash64("word").alias("h")),
                  [*AT, "part"])
    added = parts.groupBy(*AT).agg(*[F.sum(_lane(k)).alias(f"v{k}") for k in range(BITS)],
                                   *[F.max(c).alias(c) for c in own])
    bits = F.lit(0).cast("bigint")
    for k in range(BITS):
        bits = bits.bitwiseOR(F.when(2 * F.col(f"v{k}") > F.col("n_votes"), F.lit(1 << k)).otherwise(F.lit(0).cast("bigint")))
    long = added.select(*AT, "doc_id", "k1", "k2", "n_words", bits.alias("simhash"))
    return one, long


def block_keys(simhash: Column) -> Column:
    """The pairs of blocks, each with its place, as one long each."""
    def block(b: int) -> Column:
        return F.shiftrightunsigned(simhash, BLOCK * b).bitwiseAND(F.lit((1 << BLOCK) - 1))
    pairs = list(combinations(range(BITS // BLOCK), 2))
    return F.array(*[F.lit(i << (2 * BLOCK)).bitwiseOR(F.shiftleft(block(a), BLOCK)).bitwiseOR(block(b))
                     for i, (a, b) in enumerate(pairs)])


def repeated_lines(docs: DataFrame, min_words: int = 5, percent: int = PERCENT, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """A row for each line that takes part: AT, doc_id, first_doc_id, first_line_no, kept."""
    docs = scannable(docs)
    lines = lines_of(docs, id_col, text)
    one, _ = simhashed_lines(lines, min_words)
    # more than PART words and what parts them take more than twice as many characters
    long_docs = docs.where(F.length(text) > 2 * PART)
    _, long = simhashed_lines(lines_of(long_docs, id_col, text), min_words)
    found = cut_lineage(one.unionByName(long))

    line = ["k1", "k2"]
    nodes = found.groupBy(*line).agg(F.max("simhash").alias("h"), F.max("n_words").alias("n"),
                                     F.min(F.struct("doc_id", *AT)).alias("first"))
    nodes = cut_lineage(nodes.select(*line, F.struct("n", "h").alias("size"), "first",
                                     F.monotonically_increasing_id().alias("node")))
    shared = shared_buckets(nodes.select(F.explode(block_keys(F.col("size.h"))).alias("key"), "node", "size"))
    wanted = shared.select("node").distinct().join(nodes.select("node", *[F.col(f"first.{c}").alias(c) for c in AT]), "node")
    # a side of a few hundred thousand rows is broadcast, which leaves the lines where they are; a larger one is joined
    wanted = size_checked_broadcast(cut_lineage(wanted), BROADCAST_ROWS)
    texts = lines.join(wanted, AT).select("node", as_characters(normalised_words(F.col("line"))).alias("norm"))
    texts = cut_lineage(texts)

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("norm").alias("of_a"))
        right = texts.select(F.col("node").alias("b"), F.col("norm").alias("of_b"))
        both = pairs.join(left, "a").join(right, "b")
        allowed = f"CAST((100 - {percent}) * greatest(length(of_a), length(of_b)) div 100 AS INT)"
        return both.where(F.expr(f"levenshtein(of_a, of_b, {allowed}) >= 0")).select("a", "b")

    def compatible(x: Column, y: Column) -> Column:
        return ((100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
                & (F.bit_count(x["h"].bitwiseXOR(y["h"])) <= MAX_BITS))

    groups = link_groups(shared, nodes.select("node", "size"), verify, compatible)
    grouped = nodes.select(*line, "first", "node").join(groups.withColumnRenamed("id", "node"), "node", "left")
    grouped = cut_lineage(grouped.select(*line, "first", F.coalesce("component", "node").alias("component")))
    firsts = cut_lineage(grouped.groupBy("component").agg(F.min("first").alias("first")))
    by_line = grouped.select(*line, "component").join(firsts, "component").select(*line, "first")
    out = found.select(*AT, "doc_id", *line).join(by_line, line)
    return out.select(*AT, "doc_id", F.col("first.doc_id").alias("first_doc_id"),
                      F.col("first.line_no").alias("first_line_no"),
                      (F.struct(*AT) == F.struct(*[F.col(f"first.{c}") for c in AT])).alias("kept"))


def _rarity(lines: DataFrame, min_words: int) -> bytes:
    """A byte for each of SLOTS hash slots that grows with the words in it: SLOTS numbers at most reach the driver."""
    import math
    words = lines.select(normalised_words(F.col("line")).alias("words")).where(F.size("words") >= min_words)
    words = words.select(F.explode("words").alias("word"))
    out = bytearray(SLOTS)
    for r in words.select(F.pmod(F.xxhash64("word"), F.lit(SLOTS)).alias("slot")).groupBy("slot").count().collect():
        out[r["slot"]] = min(255, int(6 * math.log2(r["count"] + 1)))
    return bytes(out)


def prefixed_lines(lines: DataFrame, min_words: int, percent: int, rarity: bytes) -> DataFrame:
    """AT, doc_id, k1, k2 (hashes of the normalised line), n (words), p0, p1 (parities) and keys of the lines that have a word.

    Lines of fewer than ``min_words`` have no keys.
    """
    words = lines.withColumn("words", normalised_words(F.col("line"))).where(F.size("words") > 0)
    hashed = words.select(*AT, "doc_id", F.array_join("words", " ").alias("norm"),
                          F.transform("words", lambda w: F.xxhash64(w)).alias("h"))

    def ranked(h: Column) -> Column:
        slot = F.pmod(h, F.lit(SLOTS)).cast("int") + 1
        return F.struct(F.substring(F.lit(rarity), slot, F.lit(1)).alias("r"), h.alias("h"))

    def parity(part: int) -> Column:
        zero = F.lit(0).cast("bigint")

        def added(bits: Column, h: Column) -> Column:
            place = F.pmod(F.shiftright(h, 20), F.lit(PARITIES)).cast("int")
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place % 64)
            return bits.bitwiseXOR(F.when(F.floor(place / 64) == part, bit).otherwise(zero))
        return F.aggregate("h", zero, added)

    edits = F.floor((100 - percent) * F.size("h") / percent).cast("int")
    taken = F.when(F.size("h") >= min_words, edits + 1).otherwise(0)
    first = F.slice(F.sort_array(F.transform(F.array_distinct("h"), ranked)), 1, taken)
    return hashed.select(*AT, "doc_id", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"),
                         F.size("h").cast("bigint").alias("n"), parity(0).alias("p0"), parity(1).alias("p1"),
                         F.transform(first, lambda x: x["h"]).alias("keys"))


def line_verdicts(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """A row for each line that has a word: AT, doc_id, first_doc_id, first_line_no, kept."""
    docs = scannable(docs)
    lines = lines_of(docs, id_col, text)
    found = cut_lineage(prefixed_lines(lines, min_words, percent, _rarity(lines, min_words)))

    line = ["k1", "k2"]
    nodes = found.groupBy(*line).agg(*[F.any_value(c).alias(c) for c in ("n", "p0", "p1", "keys")],
                                     F.min(F.struct("doc_id", *AT)).alias("first"))
    nodes = cut_lineage(nodes.select(*line, F.struct("n", "p0", "p1").alias("size"), "keys", "first",
                                     F.monotonically_increasing_id().alias("node")))
    sizes = nodes.select("node", "size")
    shared = shared_buckets(nodes.select(F.explode("keys").alias("key"), "node"))
    shared = cut_lineage(shared.join(sizes, "node"))
    wanted = shared.select("node").distinct().join(nodes.select("node", *[F.col(f"first.{c}").alias(c) for c in AT]), "node")
    # a side of a few hundred thousand rows is broadcast, which leaves the lines where they are; a larger one is joined
    wanted = size_checked_broadcast(cut_lineage(wanted), BROADCAST_ROWS)
    texts = lines.join(wanted, AT).select("node", as_characters(normalised_words(F.col("line"))).alias("norm"))
    texts = cut_lineage(texts)

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("norm").alias("of_a"))
        right = texts.select(F.col("node").alias("b"), F.col("norm").alias("of_b"))
        both = pairs.join(left, "a").join(right, "b")
        allowed = f"CAST((100 - {percent}) * greatest(length(of_a), length(of_b)) div 100 AS INT)"
        return both.where(F.expr(f"levenshtein(of_a, of_b, {allowed}) >= 0")).select("a", "b")

    def compatible(x: Column, y: Column) -> Column:
        longer = F.greatest(x["n"], y["n"])
        unlike = F.bit_count(x["p0"].bitwiseXOR(y["p0"])) + F.bit_count(x["p1"].bitwiseXOR(y["p1"]))
        return (100 * F.least(x["n"], y["n"]) >= percent * longer) & (100 * unlike <= 2 * (100 - percent) * longer)

    groups = link_groups(shared, sizes, verify, compatible)
    grouped = nodes.select(*line, "first", "node").join(groups.withColumnRenamed("id", "node"), "node", "left")
    grouped = cut_lineage(grouped.select(*line, "first", F.coalesce("component", "node").alias("component")))
    firsts = cut_lineage(grouped.groupBy("component").agg(F.min("first").alias("first")))
    by_line = cut_lineage(grouped.select(*line, "component").join(firsts, "component").select(*line, "first"))
    out = found.select(*AT, "doc_id", *line).join(by_line, line)
    return out.select(*AT, "doc_id", F.col("first.doc_id").alias("first_doc_id"),
                      F.col("first.line_no").alias("first_line_no"),
                      (F.struct(*AT) == F.struct(*[F.col(f"first.{c}") for c in AT])).alias("kept"))


def _packed(word: Column) -> Column:
    """A word as a long: shorter words are larger, the low WIDTH bits are a hash."""
    length = F.lit(LONGEST) - F.least(F.length(word), F.lit(LONGEST))
    return F.shiftleft(length.cast("bigint"), WIDTH).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 64 - WIDTH))


def _majority(voters: Column, size: Column, planes: int) -> Column:
    """The bits set in more than half of the longs ``voters``, of which there are less than 2 ** (planes - 1).

    All bits are counted at once: plane k of the counter holds digit k of each bit's count. The counts
    start at what lacks to the highest plane, so that plane is the answer.
    """
    lacks = F.lit((1 << (planes - 1)) - 1) - F.floor(size / 2)

    def digit(k: int) -> Column:
        return -F.call_function("shiftrightunsigned", lacks.cast("bigint"), F.lit(k)).bitwiseAND(F.lit(1).cast("bigint"))

    def add(counts: Column, word: Column) -> Column:
        out, carry = [], word
        for k in range(planes):
            out.append(counts[f"c{k}"].bitwiseXOR(carry).alias(f"c{k}"))
            carry = carry.bitwiseAND(counts[f"c{k}"])
        return F.struct(*out)

    start = F.struct(*[digit(k).alias(f"c{k}") for k in range(planes)])
    return F.aggregate(voters, start, add, lambda counts: counts[f"c{planes - 1}"].bitwiseAND(F.lit((1 << WIDTH) - 1)))


def _parities(packed: Column) -> Column:
    """p0, p1, ..: for each of 64 * PARITY_WORDS places whether an odd number of words falls there; an edit changes two of them at most.

    The sorted words have the bounds of the lengths among them, so that each word is folded once, into the long of its length.
    """
    bounds = [F.lit(((LONGEST + 1 - least) << WIDTH) - 1) for least in PARITY_LENGTHS]

    def folded(part: Column) -> Column:
        one = F.lit(1).cast("bigint")
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda bits, p: bits.bitwiseXOR(F.call_function("shiftleft", one, F.hash(p))))

    def parts(words: Column) -> Column:
        at = [F.lit(0), *[F.array_position(words, x).cast("int") for x in bounds], F.size(words) + 1]
        return F.struct(*[folded(F.slice(words, at[k] + 1, at[k + 1] - at[k] - 1)).alias(f"p{k}") for k in range(PARITY_WORDS)])
    return let(F.sort_array(F.concat(packed, F.array(*bounds))), parts)


def rare_runs(packed: Column, n: Column, percent: int) -> Column:
    """Hashes of the line's rarest runs of neighbouring words, one of which any line within the allowed edits shares.

    ``packed`` are the ``n`` words in order; the line's begin and end count as words. Runs are of three words, or of two below the
    similarity at which edits could take all runs of three. Those of the longest words come first; a run that the line repeats counts as often
    as it is there, so the edits can't take more of them than that. Weighted sums of packed words stand for the runs and have the
    lengths in their high bits. Hashes of 32 bits, to take half the room; two runs that share one only meet in a bucket.
    """
    of = 3 if 3 * (100 - percent) <= 100 else 2
    ends = [F.array(*[F.lit((LONGEST << WIDTH) + k) for k in pad]) for pad in (range(of - 1), range(of - 1, 2 * of - 2))]

    def joined(runs: Column, words: Column) -> Column:
        return F.zip_with(runs, words, lambda r, w: F.coalesce(r + r + w, F.lit(0).cast("bigint")))
    if of == 2:
        runs = joined(F.concat(ends[0], packed), F.concat(packed, ends[1]))
    else:
        runs = let(F.concat(ends[0], packed, ends[1]), lambda w: joined(
            joined(F.slice(w, 1, n + 2), F.slice(w, 2, n + 2)), F.slice(w, 3, n + 2)))
    taken = F.floor(of * (100 - percent) * n / 100).cast("int") + 1
    rarest = F.slice(F.sort_array(runs), 1, taken)
    return F.array_distinct(F.transform(rarest, lambda x: F.shiftright(F.shiftleft(x, 64 - WIDTH), 32).cast("int")))


def simhash_of(voters: Column) -> Column:
    """SimHash of WIDTH bits of ``_packed`` words; up to MOST_VOTERS are counted in lanes of four bits."""
    def nibbles(voters: Column) -> Column:
        lacks = (F.lit(7) - F.floor(F.size(voters) / 2)).cast("bigint") * F.lit(NIBBLES)
        out = F.lit(0).cast("bigint")
        for s in range(4):
            def add(sums: Column, word: Column) -> Column:
                return sums + F.shiftrightunsigned(word, s).bitwiseAND(F.lit(NIBBLES))
            votes = F.aggregate(voters, lacks, add)
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(votes, 3).bitwiseAND(F.lit(NIBBLES)), s))
        return out

    def of(voters: Column) -> Column:
        size = F.size(voters)
        out = F.when(size <= MOST_VOTERS, nibbles(voters))
        for planes in PLANES[1:-1]:
            out = out.when(size < 1 << planes - 1, _majority(voters, size, planes))
        return out.otherwise(_majority(voters, size, PLANES[-1]))
    return let(voters, of)


def block_word_keys(simhash: Column, voters: Column, n: Column) -> Column:
    """A key for each of a few of the ``voters``, those of the smallest hashes: the word, the place that it picks, and the block there."""
    hashes = F.sort_array(F.transform(voters, lambda p: F.shiftleft(p, 64 - WIDTH)))

    def key(h: Column) -> Column:
        place = F.hash(h).bitwiseAND(F.lit(31)) % F.lit(WIDTH // KEY_BITS)
        return F.xxhash64(h, F.call_function("shiftright", simhash, place * KEY_BITS).bitwiseAND(F.lit((1 << KEY_BITS) - 1))).cast("bigint")
    picked = F.slice(hashes, 1, F.when(n < SHORT, SHORT_KEYS).otherwise(KEYS))
    return F.array_distinct(F.transform(picked, lambda h: F.shiftrightunsigned(key(h), 33).cast("int")))


def blocked_lines(lines: DataFrame, min_words: int, percent: int) -> DataFrame:
    """AT, doc_id, k1, k2 (hashes of the normalised line) and ``of`` of the lines that have a word.

    of: n (words), h (SimHash), p0, p1, .. (parities), keys and rare. Lines of fewer than ``min_words``
    have no keys and no rare runs. Each line is split once.
    """
    parities = [f"p{k}" for k in range(PARITY_WORDS)]
    zero = F.lit(0).cast("bigint")
    # generators and not plain columns or filters, which Catalyst would push below the split and so split twice
    words = lines.select(*AT, "doc_id", F.explode(F.array(normalised_words(F.col("line")))).alias("words")).where(F.size("words") > 0)
    long = F.size("words") >= min_words
    packed = F.when(long, F.transform("words", _packed)).otherwise(F.array().cast("array<bigint>"))
    words = words.select(*AT, "doc_id", F.size("words").alias("n"), F.array_join("words", " ").alias("norm"),
                         F.explode(F.array(packed)).alias("packed"))
    edits = F.floor((100 - percent) * F.col("n") / percent).cast("int")
    voters = F.slice(F.sort_array("packed"), 1, F.least(edits + 1 + MORE_VOTERS, F.lit(MOST_VOTERS)))
    words = words.select("*", F.explode(F.array(voters)).alias("voters"))
    words = words.select("*", F.inline(F.array(F.struct(
        F.when(F.size("packed") > 0, simhash_of(F.col("voters"))).otherwise(zero).alias("h"), _parities(F.col("packed")).alias("p")))))
    return words.select(*AT, "doc_id", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"), F.struct(
        "n", "h", *[F.col(f"p.{c}").alias(c) for c in parities], block_word_keys(F.col("h"), F.col("voters"), F.col("n")).alias("keys"),
        F.when(F.size("packed") > 0, rare_runs(F.col("packed"), F.col("n"), percent)).otherwise(F.array().cast("array<int>")).alias("rare")).alias("of"))


def hashed_lines(lines: DataFrame) -> DataFrame:
    """AT, doc_id, k1, k2 (hashes of the normalised line) of the lines that have a word, as ``blocked_lines`` has them."""
    norm = F.trim(F.regexp_replace(F.lower("line"), "[^\\p{L}\\p{N}]+", " "))
    normed = lines.select(*AT, "doc_id", F.explode(F.array(norm)).alias("norm")).where(F.col("norm") != "")
    return normed.select(*AT, "doc_id", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit(1), "norm").alias("k2"))


def _confirmed(lines: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs``, written before, whose lines reach the edit similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = wanted.join(nodes.select("node", *[F.col(f"first.{c}").alias(c) for c in AT]), "node")
    wanted = size_checked_broadcast(cut_lineage(wanted), BROADCAST_ROWS)
    coded = let(normalised_words(F.col("line")), in_two_codes)
    texts = cut_lineage(lines.join(wanted, AT).select("node", coded.alias("of")))
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("of").alias("of_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("of").alias("of_b")), "b"))
    allowed = f"CAST((100 - {percent}) * greatest(length(of_a.x), length(of_b.x)) div 100 AS INT)"
    alike = " AND ".join(f"levenshtein(of_a.{c}, of_b.{c}, {allowed}) >= 0" for c in "xy")
    return both.where(F.expr(alike)).select("a", "b")


def simhash_verdicts(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """A row for each line that has a word: AT, doc_id, first_doc_id, first_line_no, kept."""
    docs = scannable(docs)
    lines = lines_of(docs, id_col, text)
    line, parities = ["k1", "k2"], [f"p{k}" for k in range(PARITY_WORDS)]
    # the records go straight to their nodes; what each line needs later is two hashes, which cost less to take again than records to keep
    found = blocked_lines(lines, min_words, percent)
    nodes = found.groupBy(*line).agg(F.any_value("of").alias("of"), F.min(F.struct("doc_id", *AT)).alias("first"))
    nodes = cut_lineage(nodes.select(*line, "of.*", "first", F.monotonically_increasing_id().alias("node")))
    bounds = ["n", *parities]

    def may_link(x: str, y: str) -> Column:
        most = F.greatest(f"n{x}", f"n{y}")
        unlike = sum((F.bit_count(F.col(f"{p}{x}").bitwiseXOR(F.col(f"{p}{y}"))) for p in parities), F.lit(0))
        return (100 * F.least(f"n{x}", f"n{y}") >= percent * most) & (100 * unlike <= 2 * (100 - percent) * most)

    def side(x: str) -> DataFrame:
        return nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}{x}") for c in bounds])

    # most nodes are unlike their leader by length or SimHash, which both rows hold; the parities are fetched for the others
    members = nodes.select(F.explode("keys").alias("key"), "node", "n", "h")
    led = led_buckets(members, nodes.select(F.col("node").alias("leader"), F.col("n").alias("n_led"), F.col("h").alias("h_led")))
    near = F.bit_count(F.col("h").bitwiseXOR(F.col("h_led"))) <= NEAR_BITS
    sized = 100 * F.least("n", "n_led") >= percent * F.greatest("n", "n_led")
    stars = led.where((F.col("node") != F.col("leader")) & sized & near).select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    stars = cut_lineage(stars.join(side("a"), "a").join(side("b"), "b").where(may_link("a", "b")).select("a", "b"))
    groups = connected_components(_confirmed(lines, nodes, stars, percent), "a", "b")

    def rare_links(part: int, parts: int) -> DataFrame:
        """(a, b) that may be links and share a run of words, of one part of these."""
        members = nodes.select(F.explode("rare").alias("key"), "node").where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        # runs of words that one node alone has are dropped before anything is carried along
        many = cut_lineage(members.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > 1).select("key"))
        rows = members.join(many, "key").join(groups.withColumnRenamed("id", "node"), "node", "left")
        rows = cut_lineage(rows.select("key", "node", F.coalesce("component", "node").alias("component")))
        rows = rows.join(several(rows, "key"), "key").join(nodes.select("node", *bounds), "node")
        few = rows.where(F.col("component") != F.col("top")).select(
            "key", F.col("node").alias("a"), *[F.col(c).alias(f"{c}a") for c in bounds], F.col("component").alias("ca"))
        rest = rows.select("key", "top", F.col("node").alias("b"), *[F.col(c).alias(f"{c}b") for c in bounds], "component")
        met = few.join(rest, "key").where(
            may_link("a", "b") & (F.col("ca") != F.col("component"))
            & ((F.col("component") == F.col("top")) | (F.col("a") < F.col("b"))))
        return cut_lineage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    # one part after another, so that the disk holds the shuffle of one of them
    parts = min(MOST_PARTS, 1 + nodes.count() // PART_NODES)
    pairs = rare_links(0, parts)
    for part in range(1, parts):
        pairs = pairs.unionByName(rare_links(part, parts))
    pairs = cut_lineage((pairs.distinct() if parts > 1 else pairs).join(stars, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        more = _confirmed(lines, nodes, pairs, percent)
        groups = connected_components(
            groups.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more), "a", "b")

    grouped = cut_lineage(nodes.select("node", "first").join(groups.withColumnRenamed("id", "node"), "node"))
    firsts = cut_lineage(grouped.groupBy("component").agg(F.min("first").alias("of_group")))
    linked = grouped.select("node", "component").join(firsts, "component").select("node", "of_group")
    by_line = cut_lineage(nodes.select(*line, "node", "first").join(linked, "node", "left").select(
        *line, F.coalesce("of_group", "first").alias("first")))
    out = hashed_lines(lines).join(by_line, line)
    return out.select(*AT, "doc_id", F.col("first.doc_id").alias("first_doc_id"),
                      F.col("first.line_no").alias("first_line_no"),
                      (F.struct(*AT) == F.struct(*[F.col(f"first.{c}") for c in AT])).alias("kept"))


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT,
                        id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that are not kept."""
    docs = scannable(docs)
    gone = simhash_verdicts(docs, min_words, percent, id_col, text).where(~F.col("kept"))
    gone = cut_lineage(gone.groupBy(*ROW_ID).agg(F.collect_list("line_no").alias("_neardup_gone")))
    rows = with_row_id(docs).join(gone, ROW_ID, "left")

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_neardup_gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    rows = rows.withColumn(text, F.when(F.col("_neardup_gone").isNull(), F.col(text)).otherwise(let(F.split(text, "\n"), rest)))
    emptied = F.col("_neardup_gone").isNotNull() & ~F.col(text).rlike("[\\p{L}\\p{N}]")
    return rows.where(~emptied).select(*[F.col(f"`{c}`") for c in docs.columns])
