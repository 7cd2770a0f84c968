"""File sources: discovery by extension, content hashes, image analysis.

Discovery lists folders in tasks (``discovery``) and opens no file; hashes and headers come from one
pass over each file in pieces (``pieces``). Decoding uses Spark's ``image`` source.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from neardup import constants as C
from neardup.functions.scalars import bit_depth_from_mode, extension, quality_score, words_to_hex
from neardup.session import cut_lineage
from neardup.sources.discovery import discover
from neardup.sources.pieces import file_facts


def image_extensions(with_codecs: bool = False) -> list[str]:
    return [e for e in C.IMAGE_EXTENSIONS if with_codecs or e not in C.CODEC_EXTENSIONS]


def keep_image_paths(listing: DataFrame, with_codecs: bool = False) -> DataFrame:
    """Rows whose lowered extension is a known image type, one row per path."""
    return listing.where(extension("path").isin(image_extensions(with_codecs))).dropDuplicates(["path"])


def extension_glob(with_codecs: bool = False) -> str:
    """Case-insensitive ``pathGlobFilter`` for the known extensions.

    Applied while listing, so files of other types are never opened.
    """
    def ci(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "*.{" + ",".join(ci(e[1:]) for e in image_extensions(with_codecs)) + "}"


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, mtime, file_size) of every regular file under ``root`` (content not read)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root))
    return df.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("file_size"))


def find_image_files(spark: SparkSession, root: str, recursive: bool = True,
                     with_codecs: bool = False) -> DataFrame:
    """(path, mtime, file_size) of the image files under ``root``: hidden ones too, links resolved, no file opened."""
    return discover(spark, root, image_extensions(with_codecs), recursive)


def content_hashes(spark: SparkSession, root: str, recursive: bool = True,
                   algorithm: str = "sha256") -> DataFrame:
    """(path, file_hash) of the image files under ``root``; the hash of a file that can't be read is NULL."""
    return file_facts(find_image_files(spark, root, recursive), algorithm).select("path", "file_hash")


#: What Spark's ``image`` source decodes; a file of another known type has no pixels but is no error.
DECODED = (".bmp", ".gif", ".jpeg", ".jpg", ".jpe", ".jfif", ".png", ".wbmp")
def analyze_new(spark: SparkSession, root: str, store: DataFrame, recursive: bool = True,
                version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(stored records still valid, manifest of the files that changed or are new) of ``root``.

    Only the listing is read for known files; the others are opened one by one, whatever their times.
    """
    from neardup.operators.store import split_hits
    hits, misses = split_hits(find_image_files(spark, root, recursive), store, version)
    return hits, analyze_listed(spark, misses)


def analyze(spark: SparkSession, root: str, recursive: bool = True, with_phash: bool = True,
            with_hash: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Manifest of the image files under ``root``, or of the files of ``only`` (path, mtime, file_size)."""
    if only is not None:
        return analyze_listed(spark, only, with_phash, with_hash)
    listing = find_image_files(spark, root, recursive)
    return analyze_listed(spark, listing, with_phash, with_hash, root=root, recursive=recursive)


def _plain_path(file_path: Column) -> Column:
    """``_metadata.file_path``, a URI, as the listing writes paths."""
    plain = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:///", "file:/")


def pixel_hashes(spark: SparkSession, listing: DataFrame, root: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, fp, decoded) of the listed files that Spark's ``image`` source finds; decoded is False for damaged ones.

    With ``root`` all files under it are read; else the listed paths are given to the
    reader, so that no other file is opened (its listing is on the driver in any case).
    """
    from neardup.functions.fingerprint import phash_words
    wanted = listing.where(extension("path").isin(*DECODED)).select("path")
    if root is not None:
        reader = (spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower())
                  .option("pathGlobFilter", extension_glob()))
        images = reader.load(root)
    else:
        paths = [r.path for r in wanted.toLocalIterator()]
        if not paths:
            return wanted.select("path", F.lit(None).cast("array<bigint>").alias("fp"), F.lit(False).alias("decoded"))
        # names are taken literally, not as patterns
        images = (spark.read.format("image").option("dropInvalid", "false")
                  .load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]))
    read = F.coalesce(F.col("image.height") > 0, F.lit(False))
    return images.select(
        _plain_path(F.col("_metadata.file_path")).alias("path"),
        F.when(read, phash_words("image.data", "image.height", "image.width", "image.nChannels")).alias("fp"),
        read.alias("decoded"))


def analyze_listed(spark: SparkSession, listing: DataFrame, with_phash: bool = True, with_hash: bool = True,
                   root: str | None = None, recursive: bool = True) -> DataFrame:
    """Manifest of the listed files (path, mtime, file_size), with a gap-free ``id`` in path order.

    One pass over each file, in pieces, gives its hash and its header: format, size and
    mode. The pixel hash comes from Spark's ``image`` source. Hashes are taken in the scans, so neither
    contents nor pixels are shuffled. A file that can't be read, or a damaged one of a type
    that is decoded, gets ``error`` text instead of failing the job; other types keep
    their hash, and their size where the header tells it.
    """
    from neardup.operators.ranking import global_index
    listing = cut_lineage(listing.select("path", "mtime", "file_size"))
    ext = extension("path")
    facts = cut_lineage(file_facts(listing, "sha256" if with_hash else None))
    if with_phash:
        hashed = pixel_hashes(spark, listing, root, recursive).dropDuplicates(["path"])
        facts = facts.join(hashed, "path", "left")
    else:
        facts = facts.withColumns({"fp": F.lit(None).cast("array<bigint>"), "decoded": F.lit(None).cast("boolean")})
    damaged = ~F.coalesce("decoded", F.lit(True)) | F.col("width").isNull()
    error = F.coalesce("read_error", F.when(damaged & ext.isin(*DECODED), F.lit("cannot identify image file")))
    ok = F.col("error").isNull() & F.col("width").isNotNull()
    named = F.coalesce("format", F.when(ext != "", F.upper(F.substring(ext, 2, 10))))
    out = facts.withColumn("error", error).select(
        "path", "mtime", "file_size",
        F.when(ok, F.col("width")).otherwise(F.lit(0)).alias("width"),
        F.when(ok, F.col("height")).otherwise(F.lit(0)).alias("height"),
        F.when(ok, F.col("width").cast("bigint") * F.col("height")).otherwise(F.lit(0).cast("bigint")).alias("pixel_count"),
        F.when(ok, bit_depth_from_mode("mode")).otherwise(F.lit(0)).alias("bit_depth"),
        named.alias("format"), "file_hash", F.when(ok, F.col("fp")).alias("fp"), "error")
    out = global_index(out, ["path"], "id").withColumn("perceptual_hash", words_to_hex("fp", 4))
    q = F.when(F.col("error").isNull(), quality_score("pixel_count", "file_size", "bit_depth", "path")) \
        .otherwise(F.lit(0.0))
    return out.withColumn("quality_score", q)
