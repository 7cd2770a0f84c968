"""Adapters from the driver tables to the engine's schemas.

The driver ships text, not image files, so ``documents`` stands in for a file
collection: each row becomes one manifest row whose attributes are derived
deterministically from the row (the same expressions are in the DuckDB oracle).
Every adapter reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from neardup.functions.fingerprint import dct_hash, gray_levels, simhash_words, vector_fingerprint
from neardup.functions.scalars import quality_score, words_to_hex
from neardup.sources.tables import read_table, spread

# ---------------------------------------------------------------------------
# FIXED VALUES of the fixture adapter (documents -> manifest)
# ---------------------------------------------------------------------------
DOC_EXTENSIONS = (".png", ".jpg", ".cr2", ".gif", ".tiff", ".webp", ".JPEG", ".fits", ".txt", "")
DOC_BIT_DEPTHS = (1, 8, 16, 24, 32, 64)
DOC_HEIGHT = 4000
DOC_ERROR_EVERY = 97                 # failing=True: doc_id % 97 = 0 -> analysis error
DOC_ERROR_TEXT = "cannot identify image file"
DOC_MTIME_BASE = 1704067200          # 2024-01-01 00:00:00 UTC, + doc_id seconds
DOC_BYTES_PER_CHAR_BYTE = 1024       # file_size = UTF-8 bytes of text * 1024


def _pick(values, idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def manifest_rows(rows: DataFrame, with_fp: bool = True, failing: bool = False) -> DataFrame:
    """(doc_id, text, lang, source, n_chars) rows -> manifest(id, path, mtime, file_size, width,
    height, pixel_count, bit_depth, format, file_hash, perceptual_hash, fp, quality_score, error).

    A NULL or blank text is an error. ``failing`` adds errors by id, for the queries
    whose feature is the treatment of errors; they drop no row.
    """
    did = F.col("doc_id")
    ext = _pick(DOC_EXTENSIONS, did)
    bad = ~F.coalesce(F.col("text").rlike(r"[^ \t\n\r]"), F.lit(False))
    error = F.when(bad | (did % DOC_ERROR_EVERY == 0) if failing else bad, F.lit(DOC_ERROR_TEXT))
    m = rows.select(
        did.alias("id"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), did.cast("string"), ext).alias("path"),
        F.timestamp_seconds(F.lit(DOC_MTIME_BASE) + did).alias("mtime"),
        (F.octet_length("text").cast("bigint") * DOC_BYTES_PER_CHAR_BYTE).alias("file_size"),
        F.col("n_chars").cast("int").alias("width"),
        F.lit(DOC_HEIGHT).alias("height"),
        (F.col("n_chars").cast("bigint") * DOC_HEIGHT).alias("pixel_count"),
        _pick(DOC_BIT_DEPTHS, did).alias("bit_depth"),
        F.when(ext != "", F.upper(F.substring(ext, 2, 10))).alias("format"),
        F.sha2("text", 256).alias("file_hash"),
        error.alias("error"),
        *([F.when(error.isNull(), simhash_words("text")).alias("fp")] if with_fp else []),
    )
    if with_fp:
        m = m.withColumn("perceptual_hash", words_to_hex("fp", 4))
    q = F.when(F.col("error").isNull(),
               quality_score("pixel_count", "file_size", "bit_depth", "path")).otherwise(F.lit(0.0))
    return m.withColumn("quality_score", q)


def manifest_docs(spark: SparkSession, sf_dir: str, with_fp: bool = True, failing: bool = False) -> DataFrame:
    """documents -> manifest (B1)."""
    docs = read_table(spark, sf_dir, "documents")
    return manifest_rows(spread(docs) if with_fp else docs, with_fp, failing)


def manifest_pages(spark: SparkSession, sf_dir: str, failing: bool = False) -> DataFrame:
    """pages -> manifest rows under /pages/web/ (ids negated: -(page_id + 1))."""
    pages = read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit(PAGES_LANG).alias("lang"),
        F.lit(PAGES_SOURCE).alias("source"), F.length("html").cast("bigint").alias("n_chars"))
    return manifest_rows(pages, with_fp=False, failing=failing).withColumn("id", -(F.col("id") + 1))


def fp_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, perceptual_hash, fp) for every document (B2)."""
    docs = spread(read_table(spark, sf_dir, "documents"))
    return (docs.select("doc_id", simhash_words("text").alias("fp"))
            .withColumn("perceptual_hash", words_to_hex("fp", 4)))


def fp_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, fp ARRAY<BIGINT>(1), vec_hash) from 64-dim embeddings (B3)."""
    e = read_table(spark, sf_dir, "embeddings")
    w = vector_fingerprint("embedding", 64)
    return e.select("vec_id", F.when(w.isNotNull(), F.array(w)).alias("fp")) \
            .withColumn("vec_hash", words_to_hex("fp", 1))


def dct_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, fp ARRAY<BIGINT>(1)): DCT hash of the 64-dim embeddings taken as gray pictures of 8 x 8."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", gray_levels("embedding", 8).alias("pixels"))
    return e.select("vec_id", dct_hash("pixels", 8, 8).alias("fp"))


# ---------------------------------------------------------------------------
# FIXED VALUES of the store fixture (B4): an older store and today's listing
# ---------------------------------------------------------------------------
LISTING_CHANGED_EVERY = 7    # listing mtime moves by one day where doc_id % 7 = 0 (changed files)
STORE_ACCESS_SPREAD_DAYS = 60
STORE_NOW = 1709251200       # 2024-03-01 00:00:00 UTC, the fixed "now"
DAY = 86400
PAGES_LANG = "web"           # pages become files that were analysed once and are gone now
PAGES_SOURCE = "pages"


def store_old(spark: SparkSession, sf_dir: str, failing: bool = False) -> DataFrame:
    """Analysis store left by an earlier scan: every document, plus every page as a file
    that has since been deleted; version and access times added. No row is filtered out."""
    m = manifest_docs(spark, sf_dir, with_fp=False, failing=failing).unionByName(manifest_pages(spark, sf_dir, failing))
    return (m.withColumn("analysis_version", F.lit(1))
            .withColumn("created_at", F.col("mtime"))
            .withColumn("last_accessed", F.timestamp_seconds(
                F.lit(STORE_NOW) - (F.abs(F.col("id")) % STORE_ACCESS_SPREAD_DAYS) * DAY)))


def listing_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's listing (id, path, mtime, file_size) of every document; some were modified."""
    m = manifest_docs(spark, sf_dir, with_fp=False)
    shift = F.when(F.col("id") % LISTING_CHANGED_EVERY == 0, F.lit(DAY)).otherwise(F.lit(0))
    return m.select("id", "path", F.timestamp_seconds(F.unix_seconds("mtime") + shift).alias("mtime"), "file_size")
