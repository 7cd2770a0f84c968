"""Duplicates on arrival by keyed state: no batch reads the store.

The state holds the first path of each content hash, in Spark's state store and under its
checkpoints. Each arriving file is hashed in pieces by its task, grouped by hash, and compared
with the state of its hash only, so a batch costs its own files however many came before. A batch that is
played again after a crash starts from the state before it and gives the same rows.

A store from before the stream is read once, as the stream's first input: its rows set states
and are not reported. The rows of a batch are written under ``batch=<n>`` by Spark's own
committer; a replay replaces that folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from neardup.functions.scalars import extension
from neardup.operators import store as ST
from neardup.session import cut_lineage, ship_by_value
from neardup.sources.files import analyze_listed, image_extensions
from neardup.sources.pieces import PIECE
from neardup.streaming.incremental import arriving_files

ship_by_value(__name__)

ARRIVALS = "path string, mtime timestamp, file_size long, file_hash string, known boolean"
JUDGED = "path string, mtime timestamp, file_size long, file_hash string, first_path string, reason string"
SEED_SCHEMA = "path string, mtime timestamp, file_size long, file_hash string"


def hashed_arrivals(files: DataFrame) -> DataFrame:
    """ARRIVALS of listed files (path, mtime, file_size): hashed in pieces, NULL if a file can't be read."""
    def hashes(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from neardup.sources.discovery import filesystem
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                hasher = hashlib.sha256()
                try:
                    system, inner = filesystem(path)
                    with system.open_input_stream(inner) as opened:
                        while piece := opened.read(PIECE):
                            hasher.update(piece)
                    found.append(hasher.hexdigest())
                except (OSError, pa.ArrowException):
                    found.append(None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("path", "mtime", "file_size")), pa.array(found, pa.string()),
                 pa.array([False] * len(found))], names=[c.split()[0] for c in ARRIVALS.split(", ")])

    return files.mapInArrow(hashes, ARRIVALS)


def first_of_hash(arrivals: DataFrame) -> DataFrame:
    """JUDGED rows of streaming ARRIVALS: the first path of each content, and why a later one is a duplicate.

    reason is NULL for a first file, ``batch`` if the first one came in the same batch and
    ``store`` if it came before. Within a batch the smallest path is the first; known rows go
    before arriving ones and are not returned. A file that can't be read is nobody's duplicate.
    """
    def judge(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd
        before = state.get[0] if state.exists else None
        # the rows of one content in one batch, without contents; ``max_files_per_trigger`` bounds them
        rows = list(frames)
        known = [f.loc[f["known"], "path"] for f in rows]
        known = min((p.min() for p in known if len(p)), default=None)
        if before is None and known is not None:
            before = known
        new = [f[~f["known"]] for f in rows]
        if key[0] is None:
            first, before = None, None
        else:
            first = before or min((f["path"].min() for f in new if len(f)), default=None)
            if first is not None and not state.exists:
                state.update((first,))
        for f in new:
            if len(f):
                other = f["path"] != first
                reason = None if first is None else "store" if before is not None else "batch"
                out = f[["path", "mtime", "file_size", "file_hash"]].copy()
                out["first_path"] = first
                out["reason"] = pd.Series([reason if o else None for o in other], index=f.index, dtype=object)
                yield out

    return arrivals.groupBy("file_hash").applyInPandasWithState(
        judge, JUDGED, "first_path string", "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, source_dir: str, store_dir: str, duplicates_dir: str, checkpoint_location: str,
          known_dir: str | None = None, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; returns the ``StreamingQuery``.

    Each batch writes its duplicates (path, file_hash, first_path, reason) and the analysis of all its files, the
    same rows that ``analyze`` gives with version and times, under ``batch=<n>`` of the two
    folders. ``known_dir`` is a Parquet store (path, mtime, file_size, file_hash) from before.
    """
    files = arriving_files(spark, source_dir, max_files_per_trigger)
    files = files.where(extension("path").isin(image_extensions())).select(
        "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("file_size"))
    rows = hashed_arrivals(files)
    if known_dir is not None:
        seeds = spark.readStream.schema(SEED_SCHEMA).option("recursiveFileLookup", "true").parquet(known_dir)
        rows = rows.unionByName(seeds.where(F.col("file_hash").isNotNull()).withColumn("known", F.lit(True)))

    def on_batch(batch: DataFrame, number: int) -> None:
        judged = cut_lineage(batch)        # the state's function runs once
        judged.where(F.col("reason").isNotNull()).select("path", "file_hash", "first_path", "reason").write.mode(
            "overwrite").parquet(f"{duplicates_dir.rstrip('/')}/batch={number}")
        now = F.current_timestamp()
        found = analyze_listed(spark, judged.select("path", "mtime", "file_size"), with_hash=False).drop("file_hash", "id")
        found = found.join(judged.select("path", "file_hash"), "path").select(
            "*", F.lit(ST.ANALYSIS_VERSION).alias("analysis_version"), now.alias("created_at"), now.alias("last_accessed"))
        found.write.mode("overwrite").parquet(f"{store_dir.rstrip('/')}/batch={number}")

    writer = (first_of_hash(rows).writeStream.outputMode("append").foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
