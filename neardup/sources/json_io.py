"""Manifest records from JSON lines, with the defaults of the record model.

Missing numbers become 0, missing strings NULL (absent), and ``pixel_count``
is derived as width * height when it is not given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from neardup.functions.scalars import hex_to_words
from neardup.operators.ranking import global_index

MANIFEST_JSON_SCHEMA = ("path STRING, file_size BIGINT, width INT, height INT, pixel_count BIGINT, "
                        "bit_depth INT, format STRING, file_hash STRING, perceptual_hash STRING, "
                        "quality_score DOUBLE, error STRING, mtime DOUBLE")


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(MANIFEST_JSON_SCHEMA).json(path)
    w = F.coalesce("width", F.lit(0))
    h = F.coalesce("height", F.lit(0))
    out = raw.select(
        "path",
        F.coalesce("file_size", F.lit(0).cast("bigint")).alias("file_size"),
        w.alias("width"), h.alias("height"),
        F.coalesce("pixel_count", w.cast("bigint") * h).alias("pixel_count"),
        F.coalesce("bit_depth", F.lit(0)).alias("bit_depth"),
        F.nullif("format", F.lit("")).alias("format"),
        F.nullif("file_hash", F.lit("")).alias("file_hash"),
        F.nullif("perceptual_hash", F.lit("")).alias("perceptual_hash"),
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        "error", F.timestamp_seconds("mtime").alias("mtime"), hex_to_words("perceptual_hash").alias("fp"))
    return global_index(out, ["path"], "id")
