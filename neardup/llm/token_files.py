"""Token ids in binary files, bit- or byte-plane shuffled.

Documents are dealt out by ranges of their id and encoded in ascending order.
A file holds segments of whole documents. A segment is cut into blocks of a fixed
number of ids; each block is transposed into its byte planes (or bit planes) and
every plane is compressed with zstandard by itself: the planes of the high bits
nearly vanish. The segment's chunk index names each plane's place, so that a
reader opens one block without the others.

A segment is one row of a Parquet file without Parquet compression:

    shard, segment  place of the segment in the order of the documents
    n_ids           ids in the segment
    block_ids       ids of a block (the last may hold fewer)
    planes          planes of a block: 4 byte planes or 32 bit planes
    chunk_index     end of each plane in ``payload``, block after block
    payload         the compressed planes
    doc_ids, doc_lens   the documents of the segment and their number of ids

Spark's writer commits each task's file as a whole, so a lost executor leaves no
half-written segment, and any store that Spark reaches will do. Segments are
independent: files are read back without a shuffle. The largest thing in a
worker is a segment: ``segment_ids`` ids or one document.

Defined cases: a null or empty text is the end id alone; a null doc_id comes
first; rows that share a doc_id are ordered by a hash of their text and each is
a document of its own; an empty table gives no files and an empty result; only
the id and the text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from neardup.llm.common import ROW_ID, by_bytes, scannable, with_row_id
from neardup.llm.vocab import ByteLevel, kept_in_worker
from neardup.session import ensure_checkpoint_dir, ship_by_value

ship_by_value(__name__)

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 21
BATCH_BYTES = 1 << 20
PLANES = {"byte": 4, "bit": 32}
LEVEL = 1

SCHEMA = ("shard int, segment long, n_ids long, block_ids int, planes int, chunk_index array<long>, "
          "payload binary, doc_ids array<long>, doc_lens array<long>")


def to_planes(ids, planes: int) -> list[bytes]:
    """The block's ids (numpy, unsigned 32-bit) as ``planes`` byte strings, lowest plane first."""
    import numpy as np
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == PLANES["byte"]:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int):
    """The ``n`` ids of a block from its planes."""
    import numpy as np
    if len(planes) == PLANES["byte"]:
        octets = np.empty((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, dtype=np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
                         for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


def pack(ids, block_ids: int, planes: int) -> tuple[list[int], bytes]:
    """(chunk index, payload) of a segment."""
    import zstandard
    press = zstandard.ZstdCompressor(level=LEVEL)
    parts, ends, at = [], [], 0
    for first in range(0, len(ids), block_ids):
        for plane in to_planes(ids[first:first + block_ids], planes):
            parts.append(press.compress(plane))
            at += len(parts[-1])
            ends.append(at)
    return ends, b"".join(parts)


def unpack_block(payload: bytes, chunk_index: list[int], k: int, n_ids: int, block_ids: int, planes: int):
    """The ids of block ``k`` alone."""
    import zstandard
    press = zstandard.ZstdDecompressor()
    n = min(block_ids, n_ids - k * block_ids)
    ends = [chunk_index[k * planes - 1] if k else 0, *chunk_index[k * planes:(k + 1) * planes]]
    size = n if planes == PLANES["byte"] else (n + 7) // 8
    return from_planes([press.decompress(payload[a:b], max_output_size=size) for a, b in zip(ends, ends[1:])], n)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text",
              planes: str = "byte", block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS) -> str:
    """Write the ids of all texts, each with ``end_id`` after it, to files under ``path`` in order of ``id_col``."""
    n_planes = PLANES[planes]
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["_id", "_hash", *ROW_ID]
    rows = (with_row_id(scannable(docs)).select(F.col(id_col).cast("bigint").alias("_id"), F.col(text).alias("_text"),
                                     F.xxhash64(text).alias("_hash"), *ROW_ID)
            .repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("_id", "_text", F.spark_partition_id().alias("_shard")))

    def segments(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        encoder = kept_in_worker(("ids", vocabulary), lambda: ByteLevel(vocabulary))
        end = np.asarray([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int64()), ("n_ids", pa.int64()),
                            ("block_ids", pa.int32()), ("planes", pa.int32()),
                            ("chunk_index", pa.list_(pa.int64())), ("payload", pa.binary()),
                            ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64()))])
        held, names, lens, segment, shard = [], [], [], 0, 0

        def closed():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            index, payload = pack(ids, block_ids, n_planes)
            row = [shard, segment, len(ids), block_ids, n_planes, index, payload, names, lens]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        n = 0
        for batch, first, last in by_bytes(batches, "_text", BATCH_BYTES):
            part = batch.slice(first, last - first)
            shard = part.column("_shard")[0].as_py()
            ids = encoder.encode([x or "" for x in part.column("_text").to_pylist()])
            for name, x in zip(part.column("_id").to_pylist(), ids):
                if n and n + len(x) // 4 + 1 > segment_ids:
                    yield closed()
                    held, names, lens, segment, n = [], [], [], segment + 1, 0
                held.append(x + end)
                names.append(name)
                lens.append(len(x) // 4 + 1)
                n += lens[-1]
        if n:
            yield closed()

    rows.mapInArrow(segments, SCHEMA).write.option("compression", "uncompressed").parquet(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone."""
    files = spark.read.schema(SCHEMA).parquet(path)

    # places: the files of a shard, then the shards, of which there are no more than tasks wrote
    sizes = files.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard_at"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sizes.withColumn("_at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
              .join(shards, F.col("shard") == F.col("_s"))
              .select(F.col("shard").alias("_s"), F.col("segment").alias("_g"), (F.col("_at") + F.col("_shard_at")).alias("_at")))

    def documents(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                blocks = -(-r["n_ids"] // r["block_ids"])
                ids = np.concatenate([unpack_block(r["payload"], r["chunk_index"], k, r["n_ids"], r["block_ids"],
                                                   r["planes"]) for k in range(blocks)])
                ends = np.cumsum(r["doc_lens"])
                starts = ends - r["doc_lens"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["segment"]] * n, pa.int64()),
                     pa.array(r["doc_ids"], pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(r["doc_lens"], pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"])

    docs = files.mapInArrow(documents, "shard int, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return (docs.join(starts, (F.col("shard") == F.col("_s")) & (F.col("segment") == F.col("_g")))
            .select("doc_id", (F.col("_at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Round trip through files in the shared folder of the session."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    return read_ids(spark, write_ids(docs, path, vocabulary, end_id))
