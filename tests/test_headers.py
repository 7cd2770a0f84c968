import struct
import zlib

import pytest

from conftest import pattern, png_bytes
from neardup.functions.headers import parse_header


def parse(data):
    return parse_header(lambda offset, size: data[offset:offset + size])


def png(width, height, bits, kind):
    ihdr = struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + ihdr + struct.pack(">I", zlib.crc32(b"IHDR" + ihdr))


def jpeg(width, height, channels, padding=0, marker=0xC0):
    frame = struct.pack(">BHHB", 8, height, width, channels) + b"\x01\x11\x00" * channels
    blocks = [(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")] + [(0xE1, b"x" * 60_000)] * padding + [(0xC4, b"\x00" * 20), (marker, frame)]
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in blocks) + b"\xff\xda"


def tiff(order, tags, at_end=False):
    o = "<" if order == b"II" else ">"
    body, extra = b"", b""
    start = 50_000 if at_end else 8
    after = start + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        packed = struct.pack(o + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(packed) > 4:
            place = struct.pack(o + "I", after + len(extra))
            extra += packed
            packed = place
        body += struct.pack(o + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\x00")
    head = order + struct.pack(o + "HI", 42, start)
    return head.ljust(start, b"\x00") + struct.pack(o + "H", len(tags)) + body + b"\x00" * 4 + extra


def bmp(width, height, bits, size=40, packed=0, alpha=0):
    if size == 12:
        return b"BM" + b"\x00" * 12 + struct.pack("<IHHHH", 12, width, height, 1, bits)
    body = struct.pack("<IiiHHI", size, width, height, 1, bits, packed) + b"\x00" * 20 + b"\x00" * 12 + struct.pack("<I", alpha)
    return b"BM" + b"\x00" * 12 + body.ljust(size, b"\x00")


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


CASES = [
    (png_bytes(pattern(20, 10)), ("PNG", 20, 10, 3, 8, "RGB")),
    (png(7, 9, 1, 0), ("PNG", 7, 9, 1, 1, "1")),
    (png(7, 9, 16, 0), ("PNG", 7, 9, 1, 16, "I;16")),
    (png(7, 9, 4, 0), ("PNG", 7, 9, 1, 4, "L")),
    (png(7, 9, 8, 3), ("PNG", 7, 9, 1, 8, "P")),
    (png(7, 9, 8, 4), ("PNG", 7, 9, 2, 8, "LA")),
    (png(7, 9, 8, 6), ("PNG", 7, 9, 4, 8, "RGBA")),
    (jpeg(640, 480, 3), ("JPEG", 640, 480, 3, 8, "RGB")),
    (jpeg(640, 480, 1, marker=0xC2), ("JPEG", 640, 480, 1, 8, "L")),
    (jpeg(640, 480, 4, padding=3), ("JPEG", 640, 480, 4, 8, "CMYK")),       # the frame is behind the first 64 KB
    (b"GIF89a" + struct.pack("<HHB", 33, 44, 0xF7), ("GIF", 33, 44, 1, 8, "P")),
    (bmp(5, -6, 24), ("BMP", 5, 6, 3, 8, "RGB")),
    (bmp(5, 6, 1), ("BMP", 5, 6, 1, 1, "1")),
    (bmp(5, 6, 8, size=12), ("BMP", 5, 6, 1, 8, "P")),
    (bmp(5, 6, 32, size=108, packed=3, alpha=0xFF000000), ("BMP", 5, 6, 4, 8, "RGBA")),
    (tiff(b"II", [(256, 4, [100]), (257, 3, [50]), (258, 3, [8, 8, 8]), (262, 3, [2]), (277, 3, [3])]), ("TIFF", 100, 50, 3, 8, "RGB")),
    (tiff(b"MM", [(256, 3, [100]), (257, 3, [50]), (258, 3, [32]), (262, 3, [1]), (339, 3, [3])], True), ("TIFF", 100, 50, 1, 32, "F")),
    (tiff(b"II", [(256, 3, [9]), (257, 3, [8]), (258, 3, [32]), (262, 3, [1])]), ("TIFF", 9, 8, 1, 32, "I")),
    (tiff(b"II", [(256, 3, [9]), (257, 3, [8]), (258, 3, [16]), (262, 3, [1])]), ("TIFF", 9, 8, 1, 16, "I;16")),
    (tiff(b"II", [(256, 3, [9]), (257, 3, [8]), (258, 3, [8] * 4), (262, 3, [5]), (277, 3, [4])]), ("TIFF", 9, 8, 4, 8, "CMYK")),
    (webp(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 70, 80)), ("WEBP", 70, 80, 3, 8, "RGB")),
    (webp(b"VP8L", b"\x2f" + struct.pack("<I", 69 | 79 << 14 | 1 << 28)), ("WEBP", 70, 80, 4, 8, "RGBA")),
    (webp(b"VP8X", bytes([0x10, 0, 0, 0]) + (69).to_bytes(3, "little") + (79).to_bytes(3, "little")), ("WEBP", 70, 80, 4, 8, "RGBA")),
    (b"8BPS" + struct.pack(">H6xHIIHH", 1, 4, 11, 12, 8, 4), ("PSD", 12, 11, 4, 8, "CMYK")),
]


@pytest.mark.parametrize("data,want", CASES, ids=[f"{i}-{w[0]}-{w[-1]}" for i, (_, w) in enumerate(CASES)])
def test_headers(data, want):
    assert parse(data) == want


def test_cut_and_unknown_bytes():
    for data, _ in CASES:
        for n in range(0, min(len(data), 90)):
            found = parse(data[:n])
            assert found is None or found[1] > 0
    assert parse(b"") is None and parse(b"not an image at all") is None
    assert parse(png(0, 9, 8, 2)) is None
