"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from neardup.session import cut_lineage, ship_by_value

ship_by_value(__name__)

#: Word separators: space and tab to carriage return, nothing else of Unicode.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = "[\\x20\\x09-\\x0D]+"

#: Columns that name one input row for good: the hash of its file and its place there.
ROW_ID = ["_neardup_file", "_neardup_row"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside ``SPACES``; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES_RE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, although ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scannable(df: DataFrame) -> DataFrame:
    """``df`` if it is read straight from files that have row indexes, else a Parquet copy of it."""
    try:
        with_row_id(df).schema  # noqa: B018  resolves the names now
        return df
    except AnalysisException:
        return cut_lineage(df)


def with_row_id(df: DataFrame) -> DataFrame:
    """``df``, which is ``scannable``, with ROW_ID.

    The id stays the same however often and wherever the rows are read.
    ``monotonically_increasing_id`` would not do: it changes when the input is
    split anew, for example after executors are lost.
    """
    meta = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(meta["file_path"]).alias(ROW_ID[0]), meta["row_index"].alias(ROW_ID[1]))


def by_bytes(batches: Iterator, column: str, limit: int) -> Iterator[tuple]:
    """(batch, first, end) slices of Arrow batches whose texts hold about ``limit`` bytes each.

    A slice has one row at least, so a text beyond the limit stands alone.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.cast(pa.int64()).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch, first, end
            first = end
