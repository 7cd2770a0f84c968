"""Reading the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition only when the scan yields fewer tasks than cores.

    A small file with one row group is one scan task; per-row Python work
    (fingerprints) would then run on one core. Large inputs already have many
    splits and are left alone (no shuffle).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
