"""Near-duplicate documents: SuperMinHash signatures, banding, verification, connected groups.

A document's set holds its distinct shingles of ``shingle`` words (lower-cased
A-Z, words parted by ``SPACES``); a shorter text is one shingle.

* Signature: SuperMinHash (Ertl 2017). Each element walks through a random
  permutation of the registers and offers register p_j the rank j + r_j, so one
  element's ranks differ in every register and the estimates vary less than with
  independent functions. The walk ends for a document once all its registers are
  filled: a later rank can't be smaller. It runs level by level over the elements
  of many documents at once.
* Documents with equal sets are one node. Its bands are the bucket keys: the 300
  registers are dealt into bands of ``width`` registers, three or four times in different
  orders, which gives about 100 bands. Wide bands matter where many documents share a
  long passage: pairs of half the similarity asked for hardly ever share one.
* ``linking`` turns buckets into groups; each link is confirmed on the full sets. What the buckets' leaders
  leave open is searched by the sets' rarest elements, which finds every pair asked for.

A pair shares a bucket with probability 1 - 2e-5 at similarity 0.85 (bands of 12; 0.5: 0.02)
and at 0.8 (bands of 9; 0.5: 0.2), and nearer to 1 for any pair more alike.

Defined cases: a null or blank text has an empty set and is linked with nothing; a
null doc_id counts as no id (it is the component_id only of itself); rows of equal
text are one group, whichever their ids; of rows that share the smallest id of
their group, ``keep_first`` keeps one; an empty table gives an empty result; other
columns are not read by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from neardup.llm.bytewords import Hasher, mix, word_hashes
from neardup.llm.common import ROW_ID, by_bytes, scannable, with_row_id
from neardup.llm.linking import link_groups, prefix_pairs, shared_buckets
from neardup.session import cut_lineage, ship_by_value

ship_by_value(__name__)

REGISTERS = 300
#: Bands wanted, and the chance for a pair at the asked similarity to share any one of them.
BANDS, BAND_CHANCE = 100, 0.14
BATCH_BYTES = 1 << 21
#: Levels worked out by tracing swaps back; longer walks (few elements) keep their permutation.
TRACED = 6


class Shingler:
    """Sets of hashed shingles (sorted, distinct, unsigned 64-bit) of texts given as UTF-8 bytes."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.hasher = Hasher()

    def sets(self, texts: list[bytes | None]) -> list:
        import numpy as np
        # bytes.lower changes A-Z only
        codes, counts = word_hashes([(t or b"").lower() for t in texts], self.hasher)
        k = self.shingle
        hashed = codes[:0]
        if len(codes) >= k:
            hashed = mix(codes[:len(codes) - k + 1])
            for j in range(1, k):
                hashed = mix(hashed + codes[j:len(codes) - k + 1 + j])
        out = []
        for n, end in zip(counts.tolist(), np.cumsum(counts).tolist()):
            if n >= k:
                out.append(np.unique(hashed[end - n:end - k + 1]))
            elif n:
                one = mix(codes[end - n:end - n + 1])
                for j in range(1, n):
                    one = mix(one + codes[end - n + j:end - n + j + 1])
                out.append(one)
            else:
                out.append(codes[:0])
        return out


def superminhash(sets: list, registers: int):
    """Signatures (len(sets) x registers, unsigned 64-bit ranks) of nonempty sets."""
    import numpy as np
    n, m = len(sets), registers
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    ranks = np.full(n * m, none, dtype=np.uint64)
    if not n:
        return ranks.reshape(0, m)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    swaps: list = []          # k of the levels so far, for the elements still walking
    order = None              # their permutations, once the walk is long
    for j in range(m):
        x = mix(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            register = k
            for i in range(j - 1, -1, -1):    # what the swaps have brought to place k
                register = np.where(register == swaps[i], i, register)
            swaps.append(k)
        else:
            columns = np.arange(len(k))
            register = order[k, columns]
            order[k, columns] = order[j]
            order[j] = register
        np.minimum.at(ranks, owner * m + register.astype(np.int64), np.uint64(j << 32) | (x >> np.uint64(32)))
        walking = (ranks.reshape(n, m) == none).any(axis=1)[owner]
        if not walking.any():
            break
        if walking.sum() < 0.8 * len(walking):
            element, owner = element[walking], owner[walking]
            swaps = [s[walking] for s in swaps]
            order = None if order is None else order[:, walking]
        if order is None and j + 1 == TRACED:
            order = np.repeat(np.arange(m, dtype=np.int16)[:, None], len(element), axis=1)
            columns = np.arange(len(element))
            for i, s in enumerate(swaps):
                order[s, columns], order[i] = order[i].copy(), order[s, columns]
    return ranks.reshape(n, m)


def bands(percent: int, seed: int = 11):
    """The registers of each band (bands x width)."""
    import math

    import numpy as np
    width = max(1, min(REGISTERS, round(math.log(BAND_CHANCE) / math.log(min(percent, 99) / 100)))) if percent > 0 else 1
    each = REGISTERS // width
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.permutation(REGISTERS)[:each * width].reshape(each, width)
                           for _ in range(max(1, round(BANDS / each)))])


def band_keys(ranks, of_bands):
    """One 64-bit key for each signature and band."""
    import numpy as np
    keys = np.broadcast_to(np.arange(len(of_bands), dtype=np.uint64), (len(ranks), len(of_bands)))
    for registers in of_bands.T:
        keys = mix(keys + ranks[:, registers] * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def signatures(docs: DataFrame, shingle: int, percent: int, id_col: str, text: str) -> DataFrame:
    """ROW_ID, doc_id, n_shingles, set_key (digest of the set, null if empty) and the band keys."""
    source = with_row_id(docs).select(F.col(text).alias("_text"), F.col(id_col).alias("doc_id"), *ROW_ID)

    def signed(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa
        shingler, of_bands = Shingler(shingle), bands(percent)
        for batch, first, end in by_bytes(batches, "_text", BATCH_BYTES):
            part = batch.slice(first, end - first)
            sets = shingler.sets(part.column("_text").cast(pa.binary()).to_pylist())
            keys: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            found = band_keys(superminhash([sets[i] for i in full], REGISTERS), of_bands)
            for i, x in zip(full, found):
                keys[i] = x
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in keys)])
            flat = found.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ["doc_id", *ROW_ID]), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", *ROW_ID, "n_shingles", "set_key", "keys"])

    schema = source.drop("_text").schema.add("n_shingles", "long").add("set_key", "binary").add("keys", T.ArrayType(T.LongType()))
    return source.mapInArrow(signed, schema)


def full_sets(docs: DataFrame, nodes: DataFrame, shingle: int, text: str) -> DataFrame:
    """(node, elements) of the nodes' own rows."""
    source = with_row_id(docs).select(F.col(text).alias("_text"), *ROW_ID).join(nodes, ROW_ID).select("_text", "node")

    def sets(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        shingler = Shingler(shingle)
        for batch, first, end in by_bytes(batches, "_text", BATCH_BYTES):
            part = batch.slice(first, end - first)
            found = shingler.sets(part.column("_text").cast(pa.binary()).to_pylist())
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["node", "elements"])

    return source.mapInArrow(sets, "node long, elements array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ROW_ID, doc_id, n_shingles, component_id and kept (doc_id = component_id).

    Links are the pairs with 100 * common >= percent * all shingles of the two sets.
    """
    docs = scannable(docs)
    signed = cut_lineage(signatures(docs, shingle, percent, id_col, text))
    nodes = (signed.where(F.col("set_key").isNotNull()).groupBy("set_key")
             .agg(F.min("doc_id").alias("first_doc"), F.min(F.struct(*ROW_ID)).alias("at"),
                  F.max("n_shingles").alias("size"), F.first("keys").alias("keys")))
    # written once, so the numbers stay
    nodes = cut_lineage(nodes.select("set_key", "first_doc", "at.*", "size", "keys",
                                     F.monotonically_increasing_id().alias("node")))
    shared = shared_buckets(nodes.select(F.explode("keys").alias("key"), "node", "size"))
    wanted = shared.select("node").distinct().join(nodes.select("node", *ROW_ID), "node")
    elements = cut_lineage(full_sets(docs, wanted, shingle, text))

    def verify(pairs: DataFrame) -> DataFrame:
        left = elements.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
        right = elements.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        both = pairs.join(left, "a").join(right, "b")
        return both.where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")

    def search(some: DataFrame) -> DataFrame:
        return prefix_pairs(elements, some, percent)

    def compatible(x: Column, y: Column) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    groups = link_groups(shared, nodes.select("node", "size"), verify, compatible, search)
    grouped = nodes.select("node", "set_key", "first_doc").join(groups.withColumnRenamed("id", "node"), "node", "left")
    grouped = cut_lineage(grouped.withColumn("component", F.coalesce("component", "node")).drop("node"))
    firsts = cut_lineage(grouped.groupBy("component").agg(F.min("first_doc").alias("component_id")))
    by_set = grouped.join(firsts, "component").select("set_key", "component", "component_id")
    out = signed.select(*ROW_ID, "doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    component_id = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component_id)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select(*ROW_ID, "doc_id", "n_shingles", "component_id", kept.alias("kept"), "component")


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
               text: str = "text") -> DataFrame:
    """One row of each group of ``docs``: that with the smallest id, then the first in the files."""
    docs = scannable(docs)
    found = cut_lineage(near_duplicates(docs, shingle, percent, id_col=id_col, text=text))
    best = (found.where(F.col("kept") & F.col("component").isNotNull()).groupBy("component")
            .agg(F.min(F.struct(*ROW_ID)).alias("at")).select("at.*"))
    alone = found.where(F.col("component").isNull()).select(*ROW_ID)
    stay = best.unionByName(alone)
    return with_row_id(docs).join(stay, ROW_ID, "left_semi").drop(*ROW_ID)
