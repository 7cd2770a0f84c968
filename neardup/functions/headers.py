"""Size, channels, bits and mode of pictures from the first bytes of their files.

``parse_header`` takes a function read(offset, size) and asks it for the bytes it needs: the
first ones, and for JPEG and TIFF those that segment lengths and directory offsets
point to. No pixel is decoded. The result is (format, width, height, channels,
bits a channel, mode) or None for bytes of no known format.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from neardup.session import ship_by_value

ship_by_value(__name__)

Read = Callable[[int, int], bytes]
Header = tuple[str, int, int, int, int, str]

#: JPEG markers of frames (those between C0 and CF that don't define tables) and markers without a length.
JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
JPEG_BARE = {0x01, *range(0xD0, 0xD9)}
#: Bytes of each TIFF field type, by its number.
TIFF_SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)


def png(read: Read) -> Header | None:
    width, height, bits, kind = struct.unpack(">IIBB", read(16, 10))
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    gray = "1" if bits == 1 else "I;16" if bits == 16 else "L"
    return "PNG", width, height, channels, bits, {0: gray, 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[kind]


def gif(read: Read) -> Header | None:
    width, height, flags = struct.unpack("<HHB", read(6, 5))
    return "GIF", width, height, 1, (flags & 7) + 1, "P"


def bmp(read: Read) -> Header | None:
    size = struct.unpack("<I", read(14, 4))[0]
    if size == 12:
        width, height, _, bits = struct.unpack("<HHHH", read(18, 8))
        packed = 0
    else:
        width, height, _, bits, packed = struct.unpack("<iiHHI", read(18, 16))
    alpha = 0
    if bits == 32 and size >= 56:
        alpha = struct.unpack("<I", read(66, 4))[0]
    mode = {1: "1", 4: "P", 8: "P"}.get(bits, "RGBA" if alpha and packed in (3, 6) else "RGB")
    channels = {"1": 1, "P": 1, "RGB": 3, "RGBA": 4}[mode]
    return "BMP", abs(width), abs(height), channels, bits if bits < 16 else 8, mode


def jpeg(read: Read) -> Header | None:
    at = 2
    while True:
        head = read(at, 4)
        if len(head) < 4 or head[0] != 0xFF:
            return None
        marker = head[1]
        if marker == 0xFF:              # fill byte
            at += 1
        elif marker in JPEG_BARE:
            at += 2
        elif marker in JPEG_FRAMES:
            bits, height, width, channels = struct.unpack(">BHHB", read(at + 4, 6))
            return "JPEG", width, height, channels, bits, {1: "L", 3: "RGB", 4: "CMYK"}.get(channels, "RGB")
        elif marker in (0xD9, 0xDA):    # the picture's data without a frame before it
            return None
        else:
            at += 2 + struct.unpack(">H", head[2:4])[0]


def tiff(read: Read) -> Header | None:
    order = "<" if read(0, 2) == b"II" else ">"
    at = struct.unpack(order + "I", read(4, 4))[0]
    n = struct.unpack(order + "H", read(at, 2))[0]
    table = read(at + 2, 12 * n)
    found: dict[int, list[int]] = {}
    for i in range(0, len(table) - 11, 12):
        tag, kind, count = struct.unpack(order + "HHI", table[i:i + 8])
        size = TIFF_SIZES[kind] if kind < len(TIFF_SIZES) else 0
        if tag in (256, 257, 258, 262, 277, 338, 339) and kind in (1, 3, 4) and count <= 64:
            body = table[i + 8:i + 12]
            if size * count > 4:
                body = read(struct.unpack(order + "I", body)[0], size * count)
            found[tag] = list(struct.unpack(order + {1: "B", 3: "H", 4: "I"}[kind] * count, body[:size * count]))
    width, height = found[256][0], found[257][0]
    samples = found.get(277, [1])[0]
    bits, colours, kind = found.get(258, [1])[0], found.get(262, [1])[0], found.get(339, [1])[0]
    if colours in (0, 1):
        if samples == 2:
            mode = "LA"
        else:
            mode = "1" if bits == 1 else "F" if kind == 3 else "I" if bits == 32 else "I;16" if bits == 16 else "L"
    else:
        mode = {2: "RGBA" if samples >= 4 and found.get(338) else "RGB", 3: "P", 5: "CMYK", 6: "YCbCr", 8: "LAB"}.get(colours, "RGB")
    return "TIFF", width, height, samples, bits, mode


def webp(read: Read) -> Header | None:
    kind = read(12, 4)
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", read(26, 4))
        return "WEBP", width & 0x3FFF, height & 0x3FFF, 3, 8, "RGB"
    if kind == b"VP8L":
        packed = struct.unpack("<I", read(21, 4))[0]
        alpha = packed >> 28 & 1
        return "WEBP", (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1, 3 + alpha, 8, "RGBA" if alpha else "RGB"
    if kind == b"VP8X":
        body = read(20, 10)
        alpha = body[0] >> 4 & 1
        width, height = (int.from_bytes(body[i:i + 3], "little") + 1 for i in (4, 7))
        return "WEBP", width, height, 3 + alpha, 8, "RGBA" if alpha else "RGB"
    return None


def psd(read: Read) -> Header | None:
    channels, height, width, bits, kind = struct.unpack(">HIIHH", read(12, 14))
    mode = {0: "1", 1: "L", 2: "P", 3: "RGBA" if channels >= 4 else "RGB", 4: "CMYK", 7: "L", 8: "L", 9: "LAB"}.get(kind, "RGB")
    return "PSD", width, height, channels, bits, mode


#: First bytes of the formats (fixed values) and their parsers.
PARSERS = ((b"\x89PNG\r\n\x1a\n", png), (b"\xff\xd8\xff", jpeg), (b"GIF87a", gif), (b"GIF89a", gif), (b"BM", bmp),
           (b"II*\x00", tiff), (b"MM\x00*", tiff), (b"8BPS", psd))


def parse_header(read: Read) -> Header | None:
    first = read(0, 16)
    parser = next((p for magic, p in PARSERS if first.startswith(magic)), None)
    if first.startswith(b"RIFF") and first[8:12] == b"WEBP":
        parser = webp
    if parser is None:
        return None
    try:
        found = parser(read)
    except (struct.error, KeyError, IndexError, ValueError):     # cut or damaged
        return None
    return found if found and found[1] > 0 and found[2] > 0 else None
