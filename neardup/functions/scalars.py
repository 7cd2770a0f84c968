"""Column expressions (all built-in, JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from neardup import constants as C

_EXT_PATTERN = r"[^/.][^/]*(\.[^/.]*)$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path) -> Column:
    """Lower-cased last suffix of the basename, '' when none or for dot-files."""
    return F.regexp_extract(F.lower(col(path)), _EXT_PATTERN, 1)


def filename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def directory(path) -> Column:
    """dirname(): everything before the last '/', '/' for top-level files."""
    p = col(path)
    d = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return (F.when(~p.contains("/"), F.lit(""))
            .when(d == "", F.lit("/"))
            .otherwise(d))


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def format_rank(ext) -> Column:
    """Quality rank of an extension; unknown extensions rank 50."""
    return F.coalesce(_literal_map(C.FORMAT_QUALITY_RANK)[col(ext)], F.lit(C.DEFAULT_FORMAT_RANK))


def bit_depth_from_mode(mode) -> Column:
    return F.coalesce(_literal_map(C.MODE_BIT_DEPTHS)[col(mode)], F.lit(C.DEFAULT_BIT_DEPTH))


def quality_score(pixel_count, file_size, bit_depth, path) -> Column:
    """Linear quality score: resolution (<=50) + size (<=30) + depth (<=10) + rank/5.

    Each of the first three terms counts only when its input is positive.
    """
    px, size, depth = col(pixel_count), col(file_size), col(bit_depth)
    res = F.when(px > 0, F.least(F.lit(50.0), px / F.lit(1_000_000.0) * 2)).otherwise(0.0)
    mib = size / F.lit(1024.0 * 1024.0)
    sz = F.when(size > 0, F.least(F.lit(30.0), mib * 3)).otherwise(0.0)
    dp = F.when(depth > 0, F.least(F.lit(10.0), depth / F.lit(3.2))).otherwise(0.0)
    fmt = format_rank(extension(path)) / F.lit(5.0)
    return (res + sz + dp + fmt).cast("double")


def resolution(width, height) -> Column:
    return F.format_string("%dx%d", col(width), col(height))


def megapixels(pixel_count) -> Column:
    """Megapixels to two decimals, ties up (integer arithmetic, no float rounding)."""
    return F.floor((col(pixel_count) + F.lit(5000)) / F.lit(10000)) / F.lit(100.0)


def one_decimal(x) -> Column:
    """``'%.1f'`` with ties to even on the exact binary value (as Python and C print it).

    ``format_number`` rounds that way (``bround`` would round the shortest decimal
    form instead, e.g. 0.35 -> 0.4); the grouping commas are removed.
    """
    return F.regexp_replace(F.format_number(col(x).cast("double"), 1), ",", "")


def format_size(size) -> Column:
    """Human-readable size in 1024 steps: '2.0 KB', '5.0 MB', '0.0 B'."""
    s = col(size).cast("double")
    expr = None
    for i, unit in enumerate(C.SIZE_UNITS):
        scaled = s / F.lit(float(1024 ** i))
        txt = F.concat(one_decimal(scaled), F.lit(" " + unit))
        cond = scaled < F.lit(1024.0)
        expr = F.when(cond, txt) if expr is None else expr.when(cond, txt)
    last = s / F.lit(float(1024 ** len(C.SIZE_UNITS)))
    return expr.otherwise(F.concat(one_decimal(last), F.lit(" " + C.SIZE_UNIT_LAST)))


def format_number(n) -> Column:
    """Thousands separators: 1234567 -> '1,234,567'."""
    return F.format_number(col(n).cast("bigint"), 0)


# ---------------------------------------------------------------------------
# fingerprints as words of 64 bits, most significant bit first
# ---------------------------------------------------------------------------

def hex_is_valid(hexcol, bits: int = 256) -> Column:
    return F.lower(col(hexcol)).rlike("^[0-9a-f]{%d}$" % (bits // 4))


def hex_to_words(hexcol, bits: int = 256) -> Column:
    """64*k hex digits -> ARRAY<BIGINT> of k words; NULL when not parsable.

    The validity test runs before ``conv`` because ``conv`` maps bad digits to 0.
    """
    h = F.lower(col(hexcol))
    words = [F.conv(F.substring(h, 1 + 16 * i, 16), 16, -10).cast("bigint")
             for i in range(bits // 64)]
    return F.when(hex_is_valid(h, bits), F.array(*words))


def words_to_hex(words, n_words: int) -> Column:
    w = col(words)
    return F.concat(*[F.lower(F.lpad(F.hex(w[i]), 16, "0")) for i in range(n_words)])


def word_cols_to_hex(cols) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(col(c)), 16, "0")) for c in cols])


def hamming(a_words, b_words) -> Column:
    """Popcount of XOR over paired word columns."""
    terms = [F.bit_count(col(a).bitwiseXOR(col(b))) for a, b in zip(a_words, b_words)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("int")


def bit_at(word_cols, pos: int) -> Column:
    """Bit ``pos`` (0 = most significant bit of word 0) as 0/1 BIGINT."""
    w = col(word_cols[pos // 64])
    return F.shiftright(w, 63 - pos % 64).bitwiseAND(F.lit(1))


def pack_bits(word_cols, positions) -> Column:
    """Bits at ``positions`` packed into one BIGINT, first position most significant."""
    k = len(positions)
    out = None
    for i, p in enumerate(positions):
        term = F.shiftleft(bit_at(word_cols, p), k - 1 - i)
        out = term if out is None else out.bitwiseOR(term)
    return out
