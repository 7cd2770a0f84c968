"""Benchmark decontamination by templates with consistent slots.

Texts are reduced to words (letters and digits; Latin letters in lower case). In
the template of a text, numbers, units after a number, and names (capitalised
words inside a sentence) are replaced by typed placeholders; the words they stand
for are the slots. Windows of ``window`` words are taken twice: as written, and,
where they have a slot, as a template, which goes on over further words until it has
enough that are no slots.

1. The hashes of all benchmark windows and runs (see 5) fill a bitmap, sized by their number. Workers
   pass on only what is in it. The runs are looked up first: a window that matches has a run
   at each place that isn't all slots, so windows are hashed only where three runs follow one another.
2. These are hash-joined with the benchmark windows.
3. A template match counts if the slots agree: along one alignment of document
   and item, each value of the item stands for one value of the document. So a
   question with other numbers or names is found, and a chance likeness of
   sentence patterns isn't.
4. A document leaks an item if ``percent`` of the item's windows are matched.
5. Copies with words changed, left out or put in, and parts of an item, lose too many
   windows for that. Runs of ``SEED`` words (as written, or with placeholders) find them:
   d edits take SEED * d at most of the item's runs that aren't all slots. Where a document
   has the rest of them, its words around them are aligned with the item's (longest common
   subsequence; a slot matches a slot of its kind). It leaks the item if ``percent`` of
   the item's words are matched and the slots agree, or if ``RUN`` words in a row are.

Items of two words and more, but fewer than a window, are one window, which is looked for at its own
length in every text. An item of one word is no passage: only a text of this word alone matches it.

Defined cases: null and blank texts and items have no windows and match nothing;
repeated rows are judged each by itself, repeated windows of an item count once
each place; empty tables give an empty result (``without_leaks``: all documents);
rows with equal item_id are one item; other columns are not read by ``leaks`` and
kept by ``without_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from neardup.llm.bytewords import CHUNK, Hasher, SEPARATORS, bounds, byte_set, mix
from neardup.llm.common import ROW_ID, by_bytes, scannable, with_row_id
from neardup.session import cut_lineage, ship_by_value

ship_by_value(__name__)

WINDOW = 5
PERCENT = 80
#: Words of a template window that must not be slots.
PLAIN_WORDS = 3
#: Words of the runs that find changed copies, and of a run that is a leak by itself.
SEED, RUN = 3, 18
#: Shifts of a document's words against an item's that are aligned in one go.
BAND = 8
#: Bits of the bitmap for each hash of the benchmark, and its least and largest size (8 KB, 256 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 1 << 16, 1 << 31

UNITS = ["mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
         "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds",
         "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years",
         "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh"]
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
           "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty",
           "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion"]
PLAIN, NUMBER, UNIT, NAME = range(4)


class Canonical:
    """Words, kinds and places of a text."""

    def __init__(self):
        import numpy as np
        letters = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
        self.kept = byte_set(letters)
        self.stops = byte_set(b".!?:;")
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.hasher = Hasher()
        self.units, self.numbers = (self._known(x) for x in (UNITS, NUMBERS))

    def _known(self, words: list[str]):
        import numpy as np
        octets = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        return np.sort(self.hasher.hashes(octets, *bounds(octets)))

    @staticmethod
    def _among(x, known):
        import numpy as np
        return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x

    def _part(self, octets):
        """(hash, first byte's place, end, upper, digit, stops) of the words of a part of a text."""
        import numpy as np
        upper = (octets >= 65) & (octets <= 90)
        small = self.lower[octets]
        # the Latin-1 capitals, which are two bytes in UTF-8
        second = np.zeros(len(octets), dtype=bool)
        second[1:] = (octets[:-1] == 0xC3) & (octets[1:] >= 0x80) & (octets[1:] <= 0x9E) & (octets[1:] != 0x97)
        small = np.where(second, small + 32, small).astype(np.uint8)
        upper[:-1] |= second[1:]
        starts, ends = bounds(octets)
        keep = self.kept[octets]
        hashes = self.hasher.hashes(small, starts, ends, keep)
        real = hashes != 0
        starts, ends, hashes = starts[real], ends[real], hashes[real]
        first = np.flatnonzero(keep)
        first = first[np.searchsorted(first, starts)] if len(starts) else starts
        feeds = np.cumsum(octets == 10)
        before = np.concatenate([[0], ends[:-1] - 1]) if len(ends) else ends
        begins = self.stops[octets[before]] | (feeds[starts] > feeds[before]) if len(ends) else np.empty(0, dtype=bool)
        if len(begins):
            begins[0] = bool((octets[:starts[0]] == 10).any())
        digit = (octets[first] >= 48) & (octets[first] <= 57)
        return hashes, starts, ends, upper[first], digit, begins

    def words(self, text: bytes):
        """(hashes, kinds, starts, ends) of the whole text, worked on in parts cut at separators."""
        import numpy as np
        parts, at, last = [], 0, None
        while at < len(text):
            end = len(text)
            if end - at > CHUNK:
                cut = max(text.rfind(bytes([s]), at + 1, at + CHUNK) for s in SEPARATORS)
                if cut < 0:
                    cut = min([x for x in (text.find(bytes([s]), at + CHUNK) for s in SEPARATORS) if x >= 0], default=end)
                end = cut
            octets = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
            hashes, starts, ends, upper, digit, begins = self._part(octets)
            if len(begins):
                begins[0] |= last is None or bool(self.stops[last])
                last = octets[ends[-1] - 1]
            parts.append((hashes, starts + at, ends + at, upper, digit, begins))
            at = end
        if not parts:
            none = np.empty(0, dtype=np.int64)
            return none.astype(np.uint64), none, none, none
        hashes, starts, ends, upper, digit, begins = (np.concatenate(x) for x in zip(*parts))
        number = digit | self._among(hashes, self.numbers)
        unit = np.zeros(len(hashes), dtype=bool)
        unit[1:] = number[:-1] & self._among(hashes[1:], self.units)
        kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(upper & ~begins, NAME, PLAIN)))
        return hashes, kinds, starts, ends


def windows(hashes, kinds, size: int):
    """(places, hashes, is template, lengths) of a text's windows as written, then of its template windows.

    A template window has ``size`` words, and as many more as it takes to hold PLAIN_WORDS that are no slots.
    """
    import numpy as np
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.int64), hashes, np.empty(0, dtype=bool), np.empty(0, dtype=np.int64)
    size = min(size, n)
    count = n - size + 1

    def joined(codes):
        out = mix(codes[:count] + np.uint64(size))
        for k in range(1, size):
            out = mix(out + codes[k:count + k])
        return out

    slots = np.concatenate([[0], np.cumsum(kinds != PLAIN)])
    plain = np.arange(n + 1) - slots
    marks = mix(np.arange(4, dtype=np.uint64) + np.uint64(1))
    codes = np.where(kinds == PLAIN, hashes, marks[kinds])
    # the first end that leaves PLAIN_WORDS behind each place
    ends = np.maximum(np.searchsorted(plain, plain[:count] + PLAIN_WORDS), np.arange(count) + size)
    template = np.flatnonzero((ends <= n) & (slots[np.minimum(ends, n)] > slots[:count]))
    ends = ends[template]
    typed = joined(codes)[template]
    longer, at = ends - template > size, template + size
    while longer.any():
        typed[longer] = mix(typed[longer] + codes[at[longer]])
        at[longer] += 1
        longer = at < ends
    places = np.concatenate([np.arange(count), template])
    lengths = np.concatenate([np.full(count, size), ends - template])
    return places, np.concatenate([joined(hashes), mix(typed)]), np.arange(len(places)) >= count, lengths


def seeds(hashes, kinds):
    """(places, hashes) of a text's runs of SEED words, as written and, where they have slots, with placeholders."""
    import numpy as np
    count = max(0, len(hashes) - SEED + 1)
    marks = mix(np.arange(4, dtype=np.uint64) + np.uint64(1))
    typed = np.where(kinds == PLAIN, hashes, marks[kinds])
    slots = np.concatenate([[0], np.cumsum(kinds != PLAIN)])
    mixed = slots[SEED:] - slots[:-SEED] if count else slots[:0]
    some = np.flatnonzero((mixed > 0) & (mixed < SEED))
    out = []
    for codes, start in ((hashes, 1 << 20), (typed, 1 << 21)):
        joined = mix(codes[:count] + np.uint64(start))
        for k in range(1, SEED):
            joined = mix(joined + codes[k:count + k])
        out.append(joined)
    return np.concatenate([np.arange(count), some]), np.concatenate([out[0], out[1][some]])


def in_bitmap(keyed, filled):
    """Which of the hashes are in the bitmap."""
    import numpy as np
    bit = (keyed & np.uint64(8 * len(filled) - 1)).astype(np.int64)
    return (filled[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def open_runs(kinds):
    """For each run of SEED words whether it has a word that is no slot."""
    import numpy as np
    slots = np.concatenate([[0], np.cumsum(kinds != PLAIN)])
    return slots[SEED:] - slots[:-SEED] < SEED


def may_have_windows(kinds, places, size: int) -> bool:
    """Whether runs found at ``places`` leave room for a window that matches: runs of slots alone may lie between them.

    A window as written of ``size`` words has size - SEED + 1 runs, and a template window of five words or more
    with PLAIN_WORDS of them no slots at least three runs that aren't all slots.
    """
    import numpy as np
    if size < SEED + 2:
        return True
    found = np.zeros(max(0, len(kinds) - SEED + 1), dtype=bool)
    found[places] = True
    broken = ~(found | ~open_runs(kinds))
    counted = np.cumsum(found)
    ends = np.flatnonzero(broken)
    at = counted[ends] if len(ends) else counted[:0]
    total = counted[-1] if len(counted) else 0
    return bool((np.diff(np.concatenate([[0], at, [total]])) >= 3).any())


def aligned(item, text, percent: int) -> tuple[bool, bool]:
    """(leak, verbatim) for (hashes, kinds) of an item and of the part of a text that it is aligned with."""
    import numpy as np
    (a, ka), (b, kb) = item, text
    n, m = len(a), len(b)
    if not n or not m:
        return False, False
    exact = a[:, None] == b[None, :]
    weight = np.where(exact, 1000, np.where((ka[:, None] == kb[None, :]) & (ka[:, None] != PLAIN), 999, 0))
    best = np.zeros((n + 1, m + 1), dtype=np.int64)
    for i in range(n):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + weight[i]))
    pairs, i, j = [], n, m
    while i and j:
        if weight[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + weight[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    pairs.reverse()
    stands, agree = {}, True
    for i, j in pairs:
        if ka[i] != PLAIN and kb[j] != PLAIN:
            agree &= stands.setdefault(int(a[i]), int(b[j])) == int(b[j])
    run, longest, last = 0, 0, None
    for i, j in pairs:
        follows = last == (i - 1, j - 1)
        counts = agree or exact[i, j]
        run = (run + 1 if follows else 1) if counts else 0
        longest, last = max(longest, run), (i, j)
    leak = (agree and 100 * len(pairs) >= percent * n) or longest >= RUN
    return leak, bool(all(exact[i, j] for i, j in pairs))


def _slot_words(text: bytes, kinds, starts, ends, place: int, size: int) -> list[str]:
    return [text[starts[i]:ends[i]].decode("utf-8", "replace").strip(".,;:!?\"'()[]").lower()
            for i in range(place, min(place + size, len(kinds))) if kinds[i] != PLAIN]


def _windows_of(rows: DataFrame, keys: list[str], size: int, bitmap: bytes | None, short: list[int] = []) -> DataFrame:
    """keys, place, n_words, n_windows, n_open, hash, template, slots and seed of the windows and seeds of _text that are in the bitmap.

    n_open is the number of runs that aren't all slots. Items (without a bitmap) of fewer words than a window have no
    seeds. In documents windows of the ``short`` sizes are taken too.
    """
    columns = {"place": "long", "n_words": "long", "n_windows": "long", "n_open": "long", "hash": "long", "template": "boolean",
               "slots": "array<string>", "seed": "boolean"}

    def taken(text: bytes, canonical: Canonical, filled):
        """(hashes, kinds, starts, ends) of a text, and (places, hashes, template, lengths, seed) of what is passed on."""
        import numpy as np
        own = canonical.words(text)
        hashes, kinds = own[0], own[1]
        n, parts = len(hashes), []
        if filled is None or n < size:
            parts.append((*windows(hashes, kinds, size), False))
        if n >= size or filled is not None:
            at, runs = seeds(hashes, kinds)
            if filled is not None:
                hit = in_bitmap(runs, filled)
                at, runs = at[hit], runs[hit]
                if n >= size and may_have_windows(kinds, at, size):
                    parts.append((*windows(hashes, kinds, size), False))
                parts += [(*windows(hashes, kinds, k), False) for k in short if k < n and k < size]
            parts.append((at, runs, np.zeros(len(at), dtype=bool), np.full(len(at), SEED), True))
        if filled is not None:
            kept = []
            for places, keyed, template, lengths, seed in parts:
                hit = slice(None) if seed else in_bitmap(keyed, filled)
                kept.append((places[hit], keyed[hit], template[hit], lengths[hit], seed))
            parts = kept
        return own, parts

    def found(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        canonical = Canonical()
        filled = None if bitmap is None else np.frombuffer(bitmap, dtype=np.uint8)
        for batch, first, end in by_bytes(batches, "_text", CHUNK):
            part = batch.slice(first, end - first)
            took: list[int] = []
            out: dict[str, list] = {c: [] for c in columns}
            for i, text in enumerate(part.column("_text").cast(pa.binary()).to_pylist()):
                (hashes, kinds, starts, ends), parts = taken(text or b"", canonical, filled)
                n, n_open = len(hashes), int(open_runs(kinds).sum())
                for places, keyed, template, lengths, seed in parts:
                    m = len(places)
                    took += [i] * m
                    out["place"] += places.tolist()
                    out["n_words"] += [n] * m
                    out["n_windows"] += [n - min(size, n) + 1] * m
                    out["n_open"] += [n_open] * m
                    out["hash"] += keyed.view(np.int64).tolist()
                    out["template"] += template.tolist()
                    out["slots"] += [_slot_words(text, kinds, starts, ends, p, k) if t else []
                                     for p, t, k in zip(places.tolist(), template.tolist(), lengths.tolist())]
                    out["seed"] += [seed] * m
            if took:
                own = part.take(pa.array(took, pa.int64()))
                types = {"long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *(pa.array(v, types[columns[c]]) for c, v in out.items())],
                                                 names=[*keys, *out])

    schema = rows.select(*keys).schema
    for name, kind in columns.items():
        schema = schema.add(name, T.ArrayType(T.StringType()) if kind == "array<string>" else kind)
    return rows.select("_text", *keys).mapInArrow(found, schema)


def _bitmap(items: DataFrame) -> bytes:
    """The bitmap of the items' hashes. A row of 64 bits for each hash at most reaches the driver, and MOST_BITS / 64 in all."""
    import numpy as np
    hashes = items.agg(F.approx_count_distinct("hash")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * hashes).bit_length()))
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = items.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("bits")).collect()
    out = np.zeros(bits // 64, dtype="<i8")
    for w in words:
        out[w["word"]] = w["bits"]
    return out.tobytes()


def _aligned_leaks(given: DataFrame, asked: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """(ROW_ID, item_id, verbatim) of the leaks among ``wanted`` (ROW_ID, item_id, bands)."""
    # a row for each document and item: a document may hold a whole benchmark
    listed = wanted.join(asked.select("item_id", F.col("_text").alias("item")), "item_id")
    both = given.select(*ROW_ID, "_text").join(cut_lineage(listed), ROW_ID)
    item_type = asked.schema["item_id"].dataType

    def judged(batches: Iterator) -> Iterator:
        import pyarrow as pa
        canonical = Canonical()
        last, words = None, None        # a document's rows follow one another
        for batch, first, end in by_bytes(batches, "_text", CHUNK):
            part = batch.slice(first, end - first)
            took, verbatim = [], []
            places = zip(*(part.column(c).to_pylist() for c in ROW_ID))
            wants = zip(part.column("item").to_pylist(), part.column("bands").to_pylist())
            for i, (place, (item, bands)) in enumerate(zip(places, wants)):
                if place != last:
                    last, words = place, canonical.words(part.column("_text")[i].as_buffer().to_pybytes())
                hashes, kinds, _, _ = words
                of_item, its_kinds, _, _ = canonical.words((item or "").encode("utf-8", "surrogatepass"))
                n = len(of_item)
                slack = n * (100 - percent) // 100
                for band in bands:
                    a, b = max(0, BAND * band - slack), BAND * (band + 1) + n + slack
                    leak, exact = aligned((of_item, its_kinds), (hashes[a:b], kinds[a:b]), percent)
                    if leak:
                        took.append(i)
                        verbatim.append(exact)
            if took:
                own = part.take(pa.array(took, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in [*ROW_ID, "item_id"]), pa.array(verbatim, pa.bool_())],
                                                 names=[*ROW_ID, "item_id", "verbatim"])

    schema = given.select(*ROW_ID).schema.add("item_id", item_type).add("verbatim", T.BooleanType())
    found = both.mapInArrow(judged, schema)
    return cut_lineage(found.groupBy(*ROW_ID, "item_id").agg(F.max("verbatim").alias("verbatim")))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, percent: int, id_col: str, text: str,
           item_id: str, item_text: str) -> DataFrame:
    """ROW_ID, doc_id, item_id, n_windows, n_matched, verbatim of the leaks."""
    asked = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_text"))
    items = cut_lineage(_windows_of(asked, ["item_id"], window, None))
    given = with_row_id(docs).select(F.col(text).alias("_text"), F.col(id_col).alias("doc_id"), *ROW_ID)
    sizes = items.where((F.col("n_words") > 1) & (F.col("n_words") < window)).select("n_words").distinct()
    short = sorted(r.n_words for r in sizes.collect())      # fewer than ``window`` numbers
    near = cut_lineage(_windows_of(given, ["doc_id", *ROW_ID], window, _bitmap(items), short))

    sides = items.select("hash", "template", "item_id", "n_windows", "n_words", "n_open", F.col("place").alias("item_place"),
                         F.col("slots").alias("item_slots"), "seed")
    every = near.drop("n_windows", "n_words", "n_open").join(sides, ["hash", "template", "seed"])
    every = cut_lineage(every.withColumn("shift", F.col("place") - F.col("item_place")))
    met = every.where(~F.col("seed"))
    pair = [*ROW_ID, "item_id"]
    slots = met.where("template").select(*pair, "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    unlike = (slots.groupBy(*pair, "shift", "s.item_slots").agg(F.min("s.slots").alias("least"), F.max("s.slots").alias("most"))
              .where(F.col("least") != F.col("most")).select(*pair, "shift").distinct())
    same = (F.xxhash64("slots") == F.xxhash64("item_slots")) & (F.col("slots") == F.col("item_slots"))
    good = (met.where(~F.col("template")).select(*pair, "doc_id", "n_windows", "item_place", F.lit(True).alias("written"))
            .unionByName(met.where("template").join(cut_lineage(unlike), [*pair, "shift"], "left_anti")
                         .select(*pair, "doc_id", "n_windows", "item_place", same.alias("written"))))
    places = good.groupBy(*pair, "item_place").agg(F.max("doc_id").alias("doc_id"), F.max("n_windows").alias("n_windows"),
                                                   F.max("written").alias("written"))
    counted = places.groupBy(*pair).agg(F.max("doc_id").alias("doc_id"), F.max("n_windows").alias("n_windows"),
                                        F.count(F.lit(1)).alias("n_matched"), F.min("written").alias("verbatim"))
    counted = cut_lineage(counted)
    whole = counted.where(100 * F.col("n_matched") >= percent * F.col("n_windows"))

    # the fewest seeds that percent of the words, or RUN of them in a row, leave
    left = F.col("n_open") - SEED * F.floor(F.col("n_words") * (100 - percent) / 100)
    seen = every.where("seed").groupBy(*pair).agg(
        F.max("doc_id").alias("doc_id"), *[F.max(c).alias(c) for c in ("n_windows", "n_words", "n_open")],
        F.countDistinct("item_place").alias("n_seeds"),
        F.collect_set(F.floor(F.col("shift") / BAND)).alias("bands"))
    wanted = cut_lineage(seen.where(F.col("n_seeds") >= F.greatest(F.lit(1), F.least(left, F.lit(RUN - SEED + 1))))
                         .join(whole.select(*pair), pair, "left_anti"))
    more = _aligned_leaks(given, asked, wanted.select(*pair, "bands"), percent)
    more = (more.join(wanted.select(*pair, "doc_id", "n_windows"), pair)
            .join(counted.select(*pair, "n_matched"), pair, "left")
            .select(*pair, "doc_id", "n_windows", F.coalesce("n_matched", F.lit(0).cast("bigint")).alias("n_matched"), "verbatim"))
    return whole.select(*more.columns).unionByName(more)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, id_col: str = "doc_id",
          text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it leaks: ROW_ID, doc_id, item_id, n_windows, n_matched, verbatim.

    ``verbatim`` is false where some window matches only as a template with other slots.
    """
    return _found(scannable(docs), benchmark, window, percent, id_col, text, item_id, item_text)


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT,
                  id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with their own columns."""
    docs = scannable(docs)
    bad = _found(docs, benchmark, window, percent, id_col, text, "item_id", "text").select(*ROW_ID).distinct()
    return with_row_id(docs).join(cut_lineage(bad), ROW_ID, "left_anti").drop(*ROW_ID)
