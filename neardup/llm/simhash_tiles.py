"""Near-duplicate documents by SimHash: exact tiled comparison of all fingerprints.

A document's shingles are its runs of ``shingle`` words (lower-cased A-Z, words parted by
``SPACES``), repeats included, joined by a space; a shorter text is one shingle. A bit of
the 64-bit fingerprint is 1 if it is set in more than half of the shingles'
XXH64 values; a text without words has fingerprint 0.

Fingerprints link at ``radius`` or fewer differing bits, all pairs of them, exactly:

* Documents of equal fingerprints are one node, so a third of all rows may be copies.
* A tile holds the fingerprints with the same population counts of their parts (1, 2, 4 or 8 parts of
  equal width, more for larger tables, so that a tile stays a few blocks). A bit that
  differs changes one count by one, so tiles whose counts differ by more than the radius in sum
  hold no link and are skipped; the others are joined by key. Any number of parts
  gives the same links.
* Tiles are cut into blocks of at most ``BLOCK`` fingerprints. A pair of blocks is one row; numpy's exclusive
  or and bit counts compare all its fingerprints. It returns a spanning forest of
  the links it finds, at most one row for each fingerprint: a cluster of near copies never
  comes out as all its pairs.
* Connected groups of the links are the result.

Defined cases: null and blank texts have fingerprint 0 and are linked like any other; a null
doc_id is no id (a group's smallest id is null only if all its ids are); repeated rows each
give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from neardup.llm.common import by_bytes
from neardup.operators.components import connected_components
from neardup.operators.ranking import global_index
from neardup.session import cut_lineage, ship_by_value

ship_by_value(__name__)

BITS = 64
SEED = 42
#: Fingerprints in a block; a pair of blocks is BLOCK * BLOCK comparisons.
BLOCK = 4096
#: Bytes of text a task holds words of at once, and elements of a comparison held at once.
SLICE_BYTES, CELLS = 1 << 20, 1 << 20
#: Parts whose population counts make a tile, from this many fingerprints on: then a tile
#: holds some thousand of them if bits are independent.
PARTS = ((0, 1), (100_000, 2), (4_000_000, 4), (1_000_000_000, 8))


def word_lists(text: bytes, shingle: int, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of ``text`` in pieces of about ``limit`` bytes; each repeats the ``shingle`` - 1 words before it.

    So every run of ``shingle`` words is in one piece, and in one only.
    """
    held: list[bytes] = []
    start = 0
    while start < len(text):
        end = start + limit
        if end < len(text):
            cut = max(text.rfind(s, start, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut < 0 and end < len(text):      # one word of more than ``limit`` bytes
                end += limit
                cut = min((x for x in (text.find(s, end - limit, end) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0),
                          default=-1)
            end = cut if cut >= 0 else len(text)
        words = held + text[start:end].split()      # bytes.split() parts at exactly SPACES
        start = max(end, start + 1)
        if start >= len(text) or len(words) >= shingle:
            yield words
            held = words[len(words) - shingle + 1:] if shingle > 1 else []
        else:
            held = words


def shingles(words: list[bytes], shingle: int) -> list[bytes]:
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return [joined[a:b - 1] for a, b in zip(starts, starts[shingle:])]


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The unsigned fingerprint of one text."""
    import numpy as np
    import xxhash
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    hashed = xxhash.xxh64_intdigest
    for words in word_lists((text or b"").lower(), shingle):    # bytes.lower changes A-Z only
        found = shingles(words, shingle)
        if len(found) == 1 and total and len(words) < shingle:
            continue        # the end of a longer text, whose runs are all counted
        values = np.array([hashed(s, SEED) for s in found], dtype="<u8")
        total += len(values)
        octets = values.view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, print) of each row; print is the fingerprint as a signed long."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("body"))

    def signed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch, first, end in by_bytes(batches, "body", SLICE_BYTES):
            part = batch.slice(first, end - first)
            found = [fingerprint(t.as_py(), shingle) for t in part.column("body")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "print"])

    return source.mapInArrow(signed, source.select("doc_id").schema.add("print", "long"))


def tile_of(value: Column, parts: int) -> Column:
    """The population counts of the parts of ``value``, seven bits each."""
    width = BITS // parts
    key = F.lit(0).cast("long")
    for k in range(parts):
        part = F.shiftrightunsigned(value, k * width)
        if parts > 1:
            part = part.bitwiseAND(F.lit((1 << width) - 1))
        key = key.bitwiseOR(F.shiftleft(F.bit_count(part).cast("long"), 7 * k))
    return key


def neighbours(parts: int, radius: int) -> list[int]:
    """Differences of tile keys with counts at most ``radius`` apart in sum, one of each two opposite ones."""
    def steps(k: int, left: int) -> Iterator[tuple[int, ...]]:
        if not k:
            yield ()
            return
        for d in range(-left, left + 1):
            for rest in steps(k - 1, left - abs(d)):
                yield (d, *rest)
    found = [d for d in steps(parts, radius) if next((x for x in d if x), 1) > 0]
    return [sum(x << (7 * k) for k, x in enumerate(d)) for d in found]


def forest(left, right, same: bool, radius: int):
    """(child, parent) values of a spanning forest of the links between two blocks (``same``: of one with itself)."""
    import numpy as np
    offset = 0 if same else len(left)
    values = left if same else np.concatenate([left, right])
    parent = np.arange(len(values))
    rows = max(1, CELLS // max(1, len(right)))
    for i in range(0, len(left), rows):
        near = np.bitwise_count(left[i:i + rows, None] ^ right[None, :]) <= radius
        u, v = np.nonzero(near)
        u, v = u + i, v + offset
        u, v = u[u != v], v[u != v]
        while len(u):
            a, b = parent[u], parent[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            if not len(u):
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    child = np.flatnonzero(parent != np.arange(len(values)))
    return values[child], values[parent[child]]


def links(prints: DataFrame, radius: int = 3, parts: int | None = None) -> DataFrame:
    """(a, b) links that connect all of ``prints`` (print: distinct longs) within ``radius`` bits of each other."""
    if parts is None:
        n = prints.count()
        parts = max(p for least, p in PARTS if n >= least)
    tiled = global_index(prints.select(tile_of(F.col("print"), parts).alias("tile"), "print"), ["tile", "print"], "at", 0)
    blocks = cut_lineage(tiled.groupBy("tile", F.expr(f"at div {BLOCK}").alias("block")).agg(F.collect_list("print").alias("prints")))
    names = blocks.select("tile", "block")
    steps = F.array(*[F.lit(d) for d in neighbours(parts, radius)])
    left = names.select(F.col("tile").alias("tile_a"), F.col("block").alias("block_a"), F.explode(steps).alias("step"))
    left = left.withColumn("tile", F.col("tile_a") + F.col("step"))
    pairs = left.join(names, "tile").where((F.col("step") != 0) | (F.col("block_a") <= F.col("block")))
    held = pairs.join(blocks.toDF("tile_a", "block_a", "left"), ["tile_a", "block_a"]).join(blocks, ["tile", "block"])
    held = held.select("left", F.col("prints").alias("right"),
                       ((F.col("step") == 0) & (F.col("block_a") == F.col("block"))).alias("same"))

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for i in range(batch.num_rows):
                one, other = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("left", "right"))
                a, b = forest(one, other, batch.column("same")[i].as_py(), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return held.mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, print (signed long), component_id (smallest doc_id of its group)."""
    signed = cut_lineage(fingerprints(docs, shingle, id_col, text))
    prints = cut_lineage(signed.groupBy("print").agg(F.min("doc_id").alias("first_doc")))
    found = cut_lineage(links(prints.select("print"), radius))
    groups = connected_components(found, "a", "b").withColumnRenamed("id", "print")
    grouped = cut_lineage(prints.join(groups, "print", "left").withColumn("component", F.coalesce("component", "print")))
    firsts = cut_lineage(grouped.groupBy("component").agg(F.min("first_doc").alias("component_id")))
    by_print = cut_lineage(grouped.join(firsts, "component").select("print", "component_id"))
    return signed.join(by_print, "print").select("doc_id", "print", "component_id")
