"""Content hashes and picture headers of listed files, read in pieces.

``binaryFile`` puts a whole file into one row, so files near 2 GB fail the job, as does one that
can't be read. Here an Arrow function gets (path, size) rows only, opens each file through
pyarrow's file systems, hashes it in pieces of ``PIECE`` bytes and takes the header from
the same open file. A file that can't be read becomes a record with its error.

Listed files are dealt to tasks by bytes: their running total in path order, cut into
shares of ``SHARE`` bytes, so that many small files make one task and a large one a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from neardup.functions.headers import parse_header
from neardup.operators.ranking import running_total
from neardup.session import cut_lineage, ship_by_value
from neardup.sources.discovery import filesystem

ship_by_value(__name__)

PIECE = 1 << 16
SHARE = 1 << 28
#: Files in a share at most (opening them counts too).
SHARE_FILES = 2000

FACTS = ("path string, mtime timestamp, file_size long, file_hash string, format string, width int, height int, channels int, "
         "bits int, mode string, read_error string")


def by_shares(listing: DataFrame, share: int = SHARE, files: int = SHARE_FILES) -> DataFrame:
    """``listing`` (path, mtime, file_size) partitioned so that tasks get about ``share`` bytes and ``files`` files each."""
    weight = F.greatest(F.coalesce("file_size", F.lit(0)).cast("double") / share, F.lit(1.0 / files))
    rows = running_total(listing.select("path", "mtime", "file_size").withColumn("_weight", weight), ["path"], "_weight", "_sum")
    rows = cut_lineage(rows.withColumn("_share", F.floor(F.col("_sum") + F.col("_weight"))))
    shares = int(rows.agg(F.sum("_weight")).first()[0] or 0) + 1
    return rows.select("path", "mtime", "file_size", "_share").repartitionByRange(shares, "_share", "path").drop("_share")


def file_facts(listing: DataFrame, algorithm: str | None = "sha256", share: int = SHARE) -> DataFrame:
    """FACTS for each row of ``listing``; ``algorithm`` None leaves the contents unread beyond the header."""
    def facts(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        def look(path: str) -> tuple:
            system, inner = filesystem(path)
            with system.open_input_file(inner) as opened:
                def read(offset: int, size: int) -> bytes:
                    return opened.read_at(size, offset)
                head = parse_header(read)
                hashed = None
                if algorithm:
                    hasher = hashlib.new(algorithm)
                    opened.seek(0)
                    while piece := opened.read(PIECE):
                        hasher.update(piece)
                    hashed = hasher.hexdigest()
            return (hashed, *(head or (None,) * 6), None)

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    found.append(look(path))
                except (OSError, pa.ArrowException) as e:
                    found.append((None,) * 7 + (f"cannot read file: {type(e).__name__}",))
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 8, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "mtime", "file_size")), *columns],
                                             names=[c.split()[0] for c in FACTS.split(", ")])

    return by_shares(listing.select("path", "mtime", "file_size"), share).mapInArrow(facts, FACTS)
