"""Fixed values.

The values below must equal the original tool's for identical results; they are
stated as data, in their natural order, and nothing else in the package hard-codes
them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: recognised image file extensions (lower case, leading dot)
# ---------------------------------------------------------------------------
IMAGE_EXTENSIONS = (
    # common formats
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif",
    # raw camera formats
    ".raw", ".cr2", ".cr3", ".nef", ".arw", ".dng", ".orf", ".rw2",
    ".pef", ".srw", ".raf", ".3fr", ".dcr", ".kdc", ".mrw", ".nrw",
    # other formats
    ".ico", ".icns", ".psd", ".psb", ".xcf", ".svg", ".eps",
    ".heic", ".heif", ".avif", ".jxl",
    ".pbm", ".pgm", ".ppm", ".pnm",
    ".tga", ".dds", ".exr", ".hdr",
    ".jp2", ".j2k", ".jpf", ".jpx", ".jpm",
    ".fits", ".fit", ".fts",
    ".pcx", ".sgi", ".rgb", ".rgba", ".bw",
)

# Extensions that need an optional codec; dropped from discovery without it.
CODEC_EXTENSIONS = (".heic", ".heif")

# ---------------------------------------------------------------------------
# FIXED VALUES: format quality rank by extension (higher = better source)
# ---------------------------------------------------------------------------
FORMAT_QUALITY_RANK = {
    # raw
    ".cr2": 100, ".cr3": 100, ".nef": 100, ".arw": 100, ".dng": 100,
    ".orf": 100, ".rw2": 100, ".pef": 100, ".srw": 100, ".raf": 100,
    ".3fr": 100, ".dcr": 100, ".kdc": 100, ".mrw": 100, ".nrw": 100,
    ".raw": 100,
    # lossless
    ".tiff": 90, ".tif": 90,
    ".png": 85,
    ".bmp": 80,
    ".psd": 80, ".psb": 80,
    ".exr": 95, ".hdr": 95,
    # modern
    ".webp": 75,
    ".avif": 75,
    ".heic": 75, ".heif": 75,
    ".jxl": 80,
    # lossy
    ".jpg": 60, ".jpeg": 60,
    ".gif": 50,
    # other
    ".ico": 40, ".icns": 40,
}
DEFAULT_FORMAT_RANK = 50

# ---------------------------------------------------------------------------
# FIXED VALUES: bit depth by image mode (default 24)
# ---------------------------------------------------------------------------
MODE_BIT_DEPTHS = {
    "1": 1, "L": 8, "P": 8, "RGB": 24, "RGBA": 32,
    "CMYK": 32, "YCbCr": 24, "LAB": 24, "HSV": 24,
    "I": 32, "F": 32, "I;16": 16, "I;16L": 16,
    "I;16B": 16, "I;16N": 16,
}
DEFAULT_BIT_DEPTH = 24

# ---------------------------------------------------------------------------
# FIXED VALUES: thresholds and LSH settings
# ---------------------------------------------------------------------------
DEFAULT_THRESHOLD = 10          # Hamming distance, inclusive
LSH_SEED = 42
# (collection size upper bound, exclusive; tables; bits per table)
LSH_SIZE_TIERS = (
    (10000, 15, 20),
    (50000, 18, 18),
    (200000, 20, 16),
    (None, 25, 14),
)
LSH_OVERLAP_FACTOR = 0.7        # cost model: overlap of candidates across tables

# Selection strategies; an unknown name falls back to "quality".
STRATEGIES = ("quality", "largest", "smallest", "newest", "oldest")

# Size units used by human-readable sizes, in steps of 1024.
SIZE_UNITS = ("B", "KB", "MB", "GB")
SIZE_UNIT_LAST = "TB"
