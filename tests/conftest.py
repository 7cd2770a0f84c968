import os
import struct
import sys
import tempfile
import zlib

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from neardup.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[4]").appName("neardup-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="neardup-test-")


def png_bytes(pixels, compress_level=6) -> bytes:
    """Encode rows of (r, g, b) tuples as an 8-bit RGB PNG (zlib only)."""
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\x00" + bytes(v for px in row for v in px) for row in pixels)

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    ihdr = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr)
            + chunk(b"IDAT", zlib.compress(raw, compress_level)) + chunk(b"IEND", b""))


def pattern(width, height, kind="gradient"):
    rows = []
    for y in range(height):
        row = []
        for x in range(width):
            fx, fy = x / width, y / height
            if kind == "gradient":
                v = int(255 * (0.6 * fx + 0.4 * fy))
                row.append((v, 255 - v, v // 2))
            elif kind == "checker":
                v = 255 if (int(fx * 8) + int(fy * 8)) % 2 else 0
                row.append((v, v, v))
            elif kind == "rings":
                d = ((fx - 0.5) ** 2 + (fy - 0.3) ** 2) ** 0.5
                v = int(127 + 127 * __import__("math").cos(d * 40))
                row.append((v, 255 - v, 128))
            else:
                row.append((200, 30, 30))
        rows.append(row)
    return rows


@pytest.fixture()
def image_dir(scratch):
    """identical1/2 (same bytes), similar (same picture, other size and compression), unique,
    a broken file, a text file,
    a sub-directory and an upper-case extension."""
    d = os.path.join(scratch, "imgs")
    os.makedirs(os.path.join(d, "sub"))
    g = png_bytes(pattern(128, 128, "rings"))
    files = {
        "identical1.png": g,
        "identical2.png": g,
        "similar.PNG": png_bytes(pattern(96, 96, "rings"), compress_level=1),
        "unique.png": png_bytes(pattern(128, 128, "checker")),
        os.path.join("sub", "other.png"): png_bytes(pattern(120, 80, "gradient")),
        "corrupted.png": b"not an image at all",
        "notes.txt": b"hello",
    }
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    return d
