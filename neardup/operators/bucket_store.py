"""The analysis store as a bucketed Spark table.

Rows are bucketed and sorted by the key (path, mtime, file_size), so a listing is joined with the store
without moving the store: only the listing is shuffled, into as many partitions as there are
buckets. The table only grows: ``append`` inserts rows and ``remove`` inserts rows that
mark keys as deleted, each with the number of its batch, through Spark's own committer. ``read``
keeps the last row of each key and version, bucket by bucket, again without a shuffle. A
batch inserted twice leaves the same rows.

The table's files are its state: another session attaches them by their folder.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from neardup.operators.store import KEY

IDENTITY = [*KEY, "analysis_version"]


class BucketStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None, buckets: int | None = None):
        """The store under ``root``; ``schema`` and ``buckets`` (default: shuffle partitions) create it.

        A store that exists is attached with the number of buckets that it was made with.
        """
        self.spark, self.root = spark, root.rstrip("/")
        self.name = "store_" + hashlib.sha256(self.root.encode()).hexdigest()[:24]
        if not spark.catalog.tableExists(self.name):
            self._attach(schema, buckets)

    def _attach(self, schema: T.StructType | None, buckets: int | None) -> None:
        options = f"{self.root}/_options"
        if schema is not None:
            columns = [f for f in schema.fields if f.name not in ("batch", "deleted")]
            columns = T.StructType([*columns, T.StructField("batch", T.LongType()), T.StructField("deleted", T.BooleanType())])
            count = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            row = self.spark.createDataFrame([(count, columns.json())], "buckets int, columns string")
            row.write.mode("error").parquet(options)
        kept = self.spark.read.parquet(options).first()
        columns = T.StructType.fromJson(json.loads(kept.columns))
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
        key = ", ".join(KEY)
        self.spark.sql(f"CREATE TABLE {self.name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                       f"INTO {kept.buckets} BUCKETS LOCATION '{self.root}/rows'")

    def _insert(self, rows: DataFrame, batch: int, deleted: bool) -> None:
        names = self.spark.table(self.name).columns
        marked = rows.drop("batch", "deleted").withColumns({"batch": F.lit(batch).cast("bigint"), "deleted": F.lit(deleted)})
        missing = {c: F.lit(None) for c in names if c not in marked.columns}
        marked.withColumns(missing).select(*names).write.insertInto(self.name)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Insert or, where key and version are known, replace."""
        self._insert(rows, batch, False)

    def remove(self, rows: DataFrame, batch: int) -> None:
        """Delete the keys and versions of ``rows``."""
        self._insert(rows.select(*IDENTITY), batch, True)

    def read(self) -> DataFrame:
        """The live rows: of each key and version the one of the last batch, unless that is a deletion."""
        # within a batch a deletion counts last
        last = Window.partitionBy(*KEY, "analysis_version").orderBy(F.desc("batch"), F.desc("deleted"))
        rows = self.spark.table(self.name).withColumn("_nth", F.row_number().over(last))
        return rows.where((F.col("_nth") == 1) & ~F.col("deleted")).drop("_nth", "batch", "deleted")

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def file_stats(self) -> DataFrame:
        """(rows, files, bytes) of all inserted rows, from the files' metadata."""
        per = (self.spark.read.parquet(f"{self.root}/rows")
               .select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"))
               .groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b")))
        return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), F.count(F.lit(1)).cast("bigint").alias("files"),
                       F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("bytes"))
