"""Incremental analysis of arriving files with Structured Streaming.

``readStream.format("binaryFile")`` picks up new image files; each micro-batch
(``foreachBatch``) hashes the content, flags exact duplicates against the store
and within the batch, and upserts the batch into the snapshot store. Near-
duplicate grouping stays a batch job: components can merge retroactively, so
appended results would be wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from neardup.functions.scalars import extension
from neardup.operators.hamming import size_checked_broadcast
from neardup.operators import store as ST
from neardup.session import cut_lineage
from neardup.sources.files import extension_glob, image_extensions

BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])

#: What a batch analysis stores and a stream leaves open: pixels are decoded by the batch ``analyze``.
OPEN_COLUMNS = {"width": "int", "height": "int", "pixel_count": "bigint", "bit_depth": "int", "format": "string",
                "perceptual_hash": "string", "quality_score": "double", "error": "string"}
STORE_COLUMNS = ["path", "mtime", "file_size", "file_hash", *OPEN_COLUMNS, "analysis_version", "created_at", "last_accessed"]


def arriving_files(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
              .option("recursiveFileLookup", "true").option("pathGlobFilter", extension_glob()))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def analyse_batch(batch: DataFrame) -> DataFrame:
    """Store rows for one micro-batch: key, SHA-256, version and times."""
    now = F.current_timestamp()
    return (batch.where(extension("path").isin(image_extensions()))
            .select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("file_size"),
                    F.sha2("content", 256).alias("file_hash"),
                    *[F.lit(None).cast(t).alias(c) for c, t in OPEN_COLUMNS.items()],
                    F.lit(ST.ANALYSIS_VERSION).alias("analysis_version"),
                    now.alias("created_at"), now.alias("last_accessed")))


def exact_on_arrival(new_rows: DataFrame, store: DataFrame | None) -> DataFrame:
    """(path, file_hash, reason) for arrivals whose content is stored under another path or repeated in the batch.

    A batch that is played again after a crash finds its own rows in the store;
    these are no duplicates of themselves.

    The store is probed with the batch's distinct hashes (a broadcast bounded by
    the micro-batch size, checked), so no shuffle of the store is needed.
    """
    per_hash = new_rows.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    in_batch = (new_rows.join(per_hash.where(F.col("n") > 1), "file_hash")
                .where(F.col("path") != F.col("first"))
                .select("path", "file_hash", F.lit("batch").alias("reason")))
    if store is None:
        return in_batch
    batch_hashes = size_checked_broadcast(new_rows.select("file_hash").where(F.col("file_hash").isNotNull())
                                          .distinct())
    seen = (store.select("file_hash", "path").join(batch_hashes, "file_hash", "left_semi")
            .groupBy("file_hash").agg(F.min("path").alias("_least"), F.max("path").alias("_most")))
    known = (new_rows.join(seen, "file_hash").where((F.col("_least") != F.col("path")) | (F.col("_most") != F.col("path")))
             .select("path", "file_hash", F.lit("store").alias("reason")))
    return known.unionByName(in_batch).dropDuplicates(["path"])


def start(spark: SparkSession, source_dir: str, store_root: str, duplicates_dir: str,
          checkpoint_location: str, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    Each epoch writes the duplicates it found (keyed by epoch, so a replayed
    epoch overwrites its own output) and appends its new rows to the store as one
    part; periodic ``SnapshotStore.compact`` folds the parts together.
    """
    snapshots = ST.SnapshotStore(spark, store_root)

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        rows = cut_lineage(analyse_batch(batch))      # the files are read and hashed once
        store = snapshots.read()
        dups = exact_on_arrival(rows, store)
        dups.withColumn("epoch", F.lit(epoch_id)).write.mode("overwrite").parquet(
            f"{duplicates_dir.rstrip('/')}/epoch={epoch_id}")
        fresh = rows if store is None else rows.join(
            store.select(*ST.KEY, "analysis_version"), [*ST.KEY, "analysis_version"], "left_anti")
        snapshots.append(fresh.select(*STORE_COLUMNS))

    writer = (arriving_files(spark, source_dir, max_files_per_trigger).writeStream
              .foreachBatch(on_batch).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
