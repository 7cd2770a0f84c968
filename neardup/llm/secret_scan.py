"""Secret scans through nested encodings.

Each whole text is searched for three kinds of secrets. Then a worklist unwraps
it: percent escapes, Unicode and character-reference escapes, and base64 runs, also
runs wrapped over lines (whose bytes may be compressed, also several times, and in
several members), each give a new layer. Base64 is read from each of the four places where its groups may
begin, since other characters of its alphabet may stand before it, as in a path. Bytes that aren't UTF-8 are read as UTF-16 where
zero bytes say so, else as Latin-1, so none are left out. A layer
is searched and unwrapped in turn until nothing new comes up. A layer that was
seen at the same place before is not taken up again, so layers that decode to
themselves end. Every character of a layer knows the span of the text it came
from, and a find is reported at that span: exact characters for escapes and plain
base64, the whole run for compressed bytes.

Defined cases: a null or empty text has no finds; each row is scanned by itself,
so ties and repeated rows don't matter; an empty table gives an empty result;
only the id and the text are read. A compressed layer is unpacked up to
``MAX_LAYER`` bytes; ``complete`` is false where one was longer, ended early, was
damaged or needs a window of more than ``MAX_WINDOW`` bytes. ``n_layers`` counts
layers of UTF-8 or UTF-16 without control characters, and others that hold a find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from neardup.llm.common import by_bytes
from neardup.session import ship_by_value

ship_by_value(__name__)

KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")   # a run is taken whole, so shorter ones needn't match first

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

#: Lines of base64; the breaks may be written as backslash and letter.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt])"
                     r"(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*+)+[A-Za-z0-9+/_-]+={0,2}")
LINE = re.compile(r"(?<!\\)[A-Za-z0-9+/_-]+|(?<=\\)(?:r\\)?n[\x20\t]*([A-Za-z0-9+/_-]+)")

BATCH_BYTES = 1 << 20
MAX_LAYER = 1 << 26
MAX_WINDOW = 1 << 27
#: Compressed bytes taken at once.
PIECE = 512
MAGIC = {b"\x1f\x8b": "gzip", b"\x78\x01": "zlib", b"\x78\x5e": "zlib", b"\x78\x9c": "zlib", b"\x78\xda": "zlib",
         b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
#: Where compressed data may begin.
STARTS = re.compile(rb"(?s)(?=(?:\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17\x72\x45\x38\x50\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd))(..)")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def finds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of each secret of one layer, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _reader(kind: str):
    if kind in ("gzip", "zlib"):
        import zlib
        return zlib.decompressobj(31 if kind == "gzip" else 15)
    if kind == "bz2":
        import bz2
        return bz2.BZ2Decompressor()
    if kind == "xz":
        import lzma
        return lzma.LZMADecompressor(format=lzma.FORMAT_XZ, memlimit=MAX_WINDOW)
    import zstandard
    return zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).decompressobj()


def unpack(data: bytes) -> tuple[bytes | None, bool]:
    """(what all members of compressed ``data`` hold, whether that is all); None if it isn't compressed."""
    magic, kind = next(((magic, kind) for magic, kind in MAGIC.items() if data.startswith(magic)), (b"", ""))
    if not kind:
        return None, True
    # two bytes, or three with a digit to follow, may begin other data
    sure = (kind in ("xz", "zstd") or kind == "gzip" and data[2:3] == b"\x08"
            or kind == "bz2" and data[4:10] in (b"1AY&SY", b"\x17\x72\x45\x38\x50\x90"))
    out, rest = bytearray(), data
    while rest.startswith(magic):
        at = 0
        try:
            reader = _reader(kind)
            while not reader.eof and at < len(rest):
                left = MAX_LAYER - len(out)
                if left <= 0:
                    return bytes(out), False
                piece, at = rest[at:at + PIECE], at + PIECE
                out += reader.decompress(piece) if kind == "zstd" else reader.decompress(piece, left)
        except Exception:  # noqa: BLE001  damaged or other data that only begins like it
            return (bytes(out), False) if out else (None, not sure)
        if not reader.eof:
            return (bytes(out), False) if out else (None, not sure)
        rest = reader.unused_data + rest[at:]
    return bytes(out[:MAX_LAYER]), len(out) <= MAX_LAYER


def as_text(data: bytes) -> tuple[str, str, bool]:
    """(text, encoding, whether it is plain text) of any bytes."""
    zeros = [data[k::2].count(0) * 4 > len(data) for k in (0, 1)]
    if data.startswith((b"\xff\xfe", b"\xfe\xff")) or zeros[0] != zeros[1]:
        encoding = "utf-16-be" if data.startswith(b"\xfe\xff") or zeros[0] else "utf-16-le"
        text = data.decode(encoding, "replace")
    else:
        encoding = "utf-8"
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            return data.decode("latin-1"), "latin-1", False
    return text, encoding, not CONTROL.search(text)


class Layer:
    """A decoded text; ``begin[i]`` to ``end[i]`` is the span of the document that gave character i."""

    def __init__(self, text: str, begin: list[int] | range, end: list[int] | range, plain: bool = True):
        self.text, self.begin, self.end, self.plain = text, begin, end, plain

    def span(self, first: int, last: int) -> tuple[int, int]:
        """Of the characters [first, last); compressed bytes all have the run's span."""
        return self.begin[first], self.end[last - 1]


def _unpacked(data: bytes, first: int, last: int) -> tuple[Layer | None, bool]:
    """The text inside compressed ``data`` found at [first, last)."""
    inner, whole = unpack(data)
    if inner is None:
        return None, whole
    seen = set()
    while inner not in seen:
        seen.add(inner)
        deeper, all_of_it = unpack(inner)
        whole &= all_of_it
        if deeper is None:
            break
        inner = deeper
    text, _, plain = as_text(inner)
    return Layer(text, [first] * len(text), [last] * len(text), plain), whole


def _substituted(layer: Layer, pattern: re.Pattern, decode) -> tuple[list[Layer], bool]:
    """The layer with each match replaced by what ``decode`` makes of it, and layers found inside matches."""
    text, begin, end = [], [], []
    more, whole, at = [], True, 0
    for m in pattern.finditer(layer.text):
        chars, inside, all_of_it = decode(layer, m)
        whole &= all_of_it
        more += inside
        if chars is None:
            continue
        for source, target in ((layer.begin, begin), (layer.end, end)):
            target.extend(source[at:m.start()])
        text.append(layer.text[at:m.start()])
        for c, a, b in chars:
            text.append(c)
            first, last = layer.span(a, b)
            begin.append(first)
            end.append(last)
        at = m.end()
    if not at:
        return more, whole
    begin.extend(layer.begin[at:])
    end.extend(layer.end[at:])
    text.append(layer.text[at:])
    return [Layer("".join(text), begin, end), *more], whole


def _percent(layer: Layer, m: re.Match):
    data = bytes.fromhex(m[0].replace("%", ""))
    inside, whole = _unpacked(data, *layer.span(m.start(), m.end()))
    if inside is not None:
        return None, [inside], whole
    chars, at = [], m.start()
    # a byte that isn't UTF-8 becomes a character of its own, so every character's bytes are known
    for c in data.decode("utf-8", "surrogateescape"):
        cut = 0xDC80 <= ord(c) <= 0xDCFF
        n = 1 if cut else len(c.encode())
        chars.append(("\ufffd" if cut else c, at, at + 3 * n))
        at += 3 * n
    return chars, [], whole


def _escape(layer: Layer, m: re.Match):
    digits = next(g for g in m.groups() if g is not None)
    code = int(digits, 10 if m[6] is not None else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None, [], True
    return [(chr(code), m.start(), m.end())], [], True


def _inner(data: bytes, layer: Layer, at: list[int] | range, first: bool) -> tuple[list[Layer], bool]:
    """Layers of compressed data inside ``data``, which the base64 at ``at`` gave; their span is the rest of the run.

    What stands before the run may be base64 characters too, so compressed data may begin at any group of
    four. Two bytes alone say little: zlib that isn't the run's very beginning counts only if it is whole.
    """
    out, whole = [], True
    for m in STARTS.finditer(data):
        if m.start() % 3:
            continue
        begins = first and not m.start()
        inside, all_of_it = _unpacked(data[m.start():], layer.begin[at[m.start() // 3 * 4]], layer.end[at[-1]])
        if begins or not m[0].startswith(b"\x78"):
            whole &= all_of_it
        elif not all_of_it:
            continue
        if inside is not None:
            out.append(inside)
            if begins:
                break
    return out, whole


def _decoded(layer: Layer, chars: str, at: list[int] | range) -> tuple[list[Layer], bool]:
    """The layers of base64 ``chars``, which stand at the places ``at`` of ``layer``: one for each of the four
    places where the first group may begin, as base64 characters may stand before it."""
    import binascii
    run = chars.rstrip("=").replace("-", "+").replace("_", "/")
    out, whole = [], True
    for phase in range(4):
        part, places = run[phase:], at[phase:]
        if len(part) % 4 == 1:   # one character more than whole bytes
            part = part[:-1]
        if len(part) < 2:
            continue
        data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        inside, all_of_it = _inner(data, layer, places, not phase)
        whole &= all_of_it
        out += inside
        if inside and not phase and data.startswith(tuple(MAGIC)):
            return out, whole
        text, encoding, plain = as_text(data)
        # most of the four are noise; one without finds and without anything to unwrap adds nothing
        if phase and not (finds(text) or any(x.search(text) for x in (PERCENT, ESCAPE, BASE64))):
            continue
        begin, end, place = [], [], 0
        for c in text:
            n = len(c.encode(encoding))
            begin.append(layer.begin[places[min(place * 8 // 6, len(part) - 1)]])
            end.append(layer.end[places[min(-(-(place + n) * 8 // 6), len(part)) - 1]])
            place += n
        out.append(Layer(text, begin, end, plain))
    return out, whole


def _base64(layer: Layer) -> tuple[list[Layer], bool]:
    out, whole, joined = [], True, []
    if "\n" in layer.text or "\\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            lines = [x.span(1) if x[1] is not None else x.span() for x in LINE.finditer(layer.text, m.start(), m.end())]
            # the last line may be a word that only follows
            for last in {len(lines), len(lines) - 1} - {0, 1}:
                at = [k for a, b in lines[:last] for k in range(a, b)]
                inside, all_of_it = _decoded(layer, "".join(layer.text[a:b] for a, b in lines[:last]), at)
                if last == len(lines):
                    joined.append((m.start(), m.end(), all_of_it and bool(inside)))
                    whole &= all_of_it
                out += inside
    done = iter(joined)
    block = next(done, None)
    for m in BASE64.finditer(layer.text):
        while block is not None and block[1] <= m.start():
            block = next(done, None)
        inside, all_of_it = _decoded(layer, m[0], range(m.start(), m.end()))
        # a line that was read whole with the lines after it may end early by itself
        whole &= all_of_it or (block is not None and block[0] <= m.start() and block[2])
        out += inside
    return out, whole


def scan(text: str) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int, bool]:
    """(finds of the text itself, finds of all layers mapped to it, number of layers, whether all was unpacked)."""
    base = finds(text)
    found = set(base)
    work = [Layer(text, range(len(text)), range(1, len(text) + 1))]
    seen, layers, whole = set(), 0, True
    while work:
        layer = work.pop()
        new = []
        if "%" in layer.text:
            more, all_of_it = _substituted(layer, PERCENT, _percent)
            new, whole = new + more, whole & all_of_it
        if "\\" in layer.text or "&#" in layer.text:
            new += _substituted(layer, ESCAPE, _escape)[0]
        more, all_of_it = _base64(layer)
        new, whole = new + more, whole & all_of_it
        for x in new:
            mark = (x.text, *x.span(0, len(x.text))) if x.text else None
            if mark is None or mark in seen:
                continue
            seen.add(mark)
            held = finds(x.text)
            layers += x.plain or bool(held)
            for first, kind, last in held:
                a, b = x.span(first, last)
                found.add((a, kind, b))
            work.append(x)
    return base, found, layers, whole


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, n_layers and complete of each whole text.

    The first four are of the text itself. Spans are ``kind:start:end`` in code points, end exclusive.
    """
    counts = [f"n_{k}" for k in KINDS]

    def scanned(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        for batch, first, last in by_bytes(batches, "_text", BATCH_BYTES):
            part = batch.slice(first, last - first)
            columns: list[list] = [[] for _ in range(7)]
            for t in part.column("_text").to_pylist():
                base, found, layers, whole = scan(t or "")
                row = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), layers, whole]
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *map(pa.array, columns, kinds)], names=names)

    names = ["_id", *counts, "base_sha256", "spans", "n_layers", "complete"]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    types = [T.LongType()] * 3 + [T.StringType(), T.StringType(), T.LongType(), T.BooleanType()]
    schema = rows.select("_id").schema
    for name, kind in zip(names[1:], types):
        schema = schema.add(name, kind)
    return rows.mapInArrow(scanned, schema).withColumnRenamed("_id", id_col)
