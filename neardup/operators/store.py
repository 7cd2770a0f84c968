"""Incremental analysis store on Parquet snapshots.

The store holds one analysed row per (path, mtime, file_size, analysis_version).
A lookup is a join of the current listing to the store; every change (upsert,
invalidate, eviction, compaction) writes a new snapshot directory and moves a
small pointer file, so readers never see a directory being overwritten.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = ["path", "mtime", "file_size"]
ANALYSIS_VERSION = 1


def split_hits(listing: DataFrame, store: DataFrame, version: int = ANALYSIS_VERSION) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): listing rows with / without a stored analysis of the same key."""
    s = store.where(F.col("analysis_version") == version)
    hits = s.join(listing.select(*KEY), KEY, "left_semi")
    misses = listing.join(s.select(*KEY), KEY, "left_anti")
    return hits, misses


def lookup(listing: DataFrame, store: DataFrame, version: int = ANALYSIS_VERSION) -> DataFrame:
    """Listing rows with ``cached`` and the stored record (its columns are NULL when not cached).

    ``cached_quality`` is the stored quality score, where the store has one.
    """
    s = store.where(F.col("analysis_version") == version)
    rest = [c for c in s.columns if c not in (*KEY, "quality_score", "id")]
    quality = F.col("quality_score") if "quality_score" in s.columns else F.lit(None).cast("double")
    s = s.select(*KEY, quality.alias("cached_quality"), *rest, F.lit(True).alias("cached"))
    return listing.select(*KEY).join(s, KEY, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def hit_rate(listing: DataFrame, store: DataFrame, version: int = ANALYSIS_VERSION) -> DataFrame:
    """One row: hits, misses, total, hit rate in percent (0 when there are no files)."""
    s = store.where(F.col("analysis_version") == version).select(*KEY, F.lit(1).alias("_hit"))
    j = listing.select(*KEY).join(s, KEY, "left")
    return j.agg(F.count_if(F.col("_hit").isNotNull()).cast("bigint").alias("cache_hits"),
                 F.count_if(F.col("_hit").isNull()).cast("bigint").alias("cache_misses"),
                 F.count(F.lit(1)).cast("bigint").alias("total_files")) \
        .withColumn("hit_rate", F.when(F.col("total_files") == 0, F.lit(0.0))
                    .otherwise(F.round(F.col("cache_hits") * 100.0 / F.col("total_files"), 6)))


def touch(store: DataFrame, hits: DataFrame, now) -> DataFrame:
    """Set ``last_accessed`` = now on the rows that were hit."""
    h = hits.select(*KEY, "analysis_version").withColumn("_hit", F.lit(True))
    return (store.join(h, [*KEY, "analysis_version"], "left")
            .withColumn("last_accessed", F.when(F.col("_hit"), F.lit(now).cast("timestamp"))
                        .otherwise(F.col("last_accessed"))).drop("_hit"))


def access_rows(hits: DataFrame, now) -> DataFrame:
    """Access-log rows for the hits of one scan: (key, analysis_version, accessed_at).

    Appending these (``SnapshotStore.append``) records the touch without
    rewriting the store; ``effective_last_access`` folds them in when needed.
    """
    return hits.select(*KEY, "analysis_version", F.lit(now).cast("timestamp").alias("accessed_at"))


def effective_last_access(store: DataFrame, access_log: DataFrame | None) -> DataFrame:
    """The store with ``last_accessed`` = latest of its own value and the access log."""
    if access_log is None:
        return store
    k = [*KEY, "analysis_version"]
    latest = access_log.groupBy(*k).agg(F.max("accessed_at").alias("_seen"))
    return (store.join(latest, k, "left")
            .withColumn("last_accessed", F.greatest("last_accessed", "_seen")).drop("_seen"))


def upsert(store: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Insert-or-replace by (key, version): old rows without a new row of the same key + new rows."""
    k = [*KEY, "analysis_version"]
    kept = store.join(new_rows.select(*k), k, "left_anti")
    return kept.unionByName(new_rows.select(*store.columns))


def invalidate(store: DataFrame, paths: DataFrame) -> DataFrame:
    """Drop every stored version of the given paths."""
    return store.join(paths.select("path"), "path", "left_anti")


def invalidate_prefix(store: DataFrame, directory: str) -> DataFrame:
    """Drop rows under ``directory`` (a true directory prefix: '/a' does not hit '/ab/x')."""
    prefix = directory.rstrip("/") + "/"
    return store.where(~F.startswith(F.col("path"), F.lit(prefix)))


def evict_stale(store: DataFrame, now, max_age_days: int = 30, access_log: DataFrame | None = None) -> DataFrame:
    """Drop rows not accessed within ``max_age_days`` before ``now`` (access log included)."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max_age_days))
    return effective_last_access(store, access_log).where(F.col("last_accessed") >= cutoff)


def evict_missing(store: DataFrame, listing: DataFrame) -> DataFrame:
    """Drop rows whose file is no longer listed."""
    return store.join(listing.select("path").distinct(), "path", "left_semi")


def stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).cast("bigint").alias("total_entries"),
                     F.countDistinct("path").cast("bigint").alias("distinct_paths"))


class SnapshotStore:
    """A directory of Parquet parts and numbered lists of the live parts.

    ``write`` replaces the store with one new part; ``append`` adds a part (an
    incremental batch costs only its own rows); ``compact`` folds the live parts
    into one; ``drop_old`` deletes parts no longer listed. A change writes its
    parts, then a list ``CURRENT-<n>`` one number higher than the last, by renaming a
    finished file to a name that must not exist. The highest list counts, so there
    is always a whole one, and of two writers at once the second fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _version(self) -> int:
        """The number of the list that counts; 0 before the first."""
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        if not fs.exists(root):
            return 0
        names = [st.getPath().getName() for st in fs.listStatus(root)]
        return max([int(n[8:]) for n in names if n.startswith("CURRENT-") and n[8:].isdigit()], default=0)

    def parts(self, version: int | None = None) -> list[str]:
        fs, jvm = self._fs()
        version = self._version() if version is None else version
        if not version:
            return []
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT-{version}"))
        try:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream))
            out = []
            line = reader.readLine()
            while line is not None:
                if line.strip():
                    out.append(line.strip())
                line = reader.readLine()
            return out
        finally:
            stream.close()

    def current(self) -> str | None:
        parts = self.parts()
        return parts[-1] if parts else None

    def read(self) -> DataFrame | None:
        parts = self.parts()
        return self.spark.read.parquet(*parts) if parts else None

    def _new_part(self, df: DataFrame, files: int | None) -> str:
        stamp = dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d%H%M%S")
        target = f"{self.root}/snap-{stamp}-{uuid.uuid4().hex[:8]}"
        (df.repartition(files) if files else df).write.mode("error").parquet(target)
        return target

    def _point(self, parts: list[str], after: int) -> None:
        """Make ``parts`` the live ones, provided that the list ``after`` still counts."""
        fs, jvm = self._fs()
        tmp = jvm.org.apache.hadoop.fs.Path(f"{self.root}/.next-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray("\n".join(parts).encode("utf-8")))
        finally:
            out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT-{after + 1}")
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise RuntimeError(f"another writer has changed the store {self.root}")

    def write(self, df: DataFrame, files: int | None = None) -> str:
        after = self._version()
        target = self._new_part(df, files)
        self._point([target], after)
        return target

    def append(self, df: DataFrame) -> str:
        target = self._new_part(df, None)
        after = self._version()
        self._point([*self.parts(after), target], after)
        return target

    def disk_stats(self) -> DataFrame | None:
        """(total_entries, files, bytes, megabytes) of the live parts, from file metadata."""
        df = self.read()
        if df is None:
            return None
        per_file = (df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
                    .groupBy("f").agg(F.count(F.lit(1)).alias("rows"), F.max("b").alias("bytes")))
        return per_file.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total_entries"),
                            F.count(F.lit(1)).cast("bigint").alias("files"),
                            F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")) \
            .withColumn("megabytes", F.round(F.col("bytes") / F.lit(1024.0 * 1024.0), 2))

    def compact(self, files: int | None = None) -> str | None:
        """Fold the parts into one; ``files`` bounds its files (default: one for each task)."""
        df = self.read()
        return self.write(df, files) if df is not None else None

    def drop_old(self) -> int:
        live = {p.rstrip("/").rsplit("/", 1)[-1] for p in self.parts()}
        fs, jvm = self._fs()
        n, last = 0, self._version()
        for number in range(1, last):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT-{number}"), False)
        for st in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.root)):
            p = st.getPath()
            if st.isDirectory() and p.getName().startswith("snap-") and p.getName() not in live:
                fs.delete(p, True)
                n += 1
        return n

    def clear(self) -> str:
        df = self.read()
        if df is None:
            raise ValueError("empty store")
        return self.write(df.limit(0))
