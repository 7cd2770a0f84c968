"""Token counts: Arrow functions that return lengths only.

Each Arrow batch is cut into slices of about ``batch_bytes`` bytes; a slice's
texts are split at boundaries that no merge crosses (``vocab``), its distinct
pieces are encoded in one call, and only their lengths are summed. No id leaves
the worker. A worker holds one slice and a bounded dictionary of piece lengths.

Defined cases: a null or empty text has 0 bytes and 0 tokens; every row is
counted by itself, so ties and repeated rows don't matter; an empty table gives an
empty result; only ``id_col`` and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from neardup.llm.common import by_bytes
from neardup.llm.vocab import ByteLevel, Known, SentencePieces, kept_in_worker
from neardup.session import ship_by_value

ship_by_value(__name__)

BATCH_BYTES = 1 << 20
CONTEXT = 4096


class PieceLengths:
    """Number of SentencePiece tokens of whole texts, without begin and end."""

    def __init__(self, name: str):
        self.pieces = SentencePieces(name)
        self.known = Known()

    def _count(self, pieces: list[str]) -> list[int]:
        """The library puts a space mark before its input; a piece without one follows a line feed here."""
        mark = self.pieces.MARK
        texts = [p[1:].replace(mark, " ") if p[0] == mark else "\n" + p for p in pieces]
        ids = self.pieces.library.encode(texts, num_threads=1)
        # the library gives nothing for an empty text, but a lone mark is a token here, as is a line feed
        return [1 if p in (mark, "\n") else len(x) if p[0] == mark else len(x) - 2 for p, x in zip(pieces, ids)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.pieces.splits:
            return [len(x) for x in self.pieces.library.encode(texts, num_threads=1)]
        split = [self.pieces.pieces(t) for t in texts]
        missing = self.known.missing(set().union(*split))
        self.known.update(zip(missing, self._count(missing)))
        out = [sum([self.known[p] for p in x]) for x in split]
        self.known.forget()
        return out


class ByteLevelLengths:
    """Number of tokens of whole texts for a byte-level BPE file, without added special tokens."""

    def __init__(self, name: str):
        self.encoder = ByteLevel(name)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.encoder.encode(texts)]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text",
                 context: int = CONTEXT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > context), a row for each row of ``docs``.

    ``vocabulary`` is a path, or the name of a file of ``public_tokenizers``: a
    ``.model`` is read by sentencepiece, a byte-level ``.json`` by tokenizers.
    """
    kind = PieceLengths if vocabulary.endswith(".model") else ByteLevelLengths

    def lengths(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        counter = kept_in_worker(("lengths", vocabulary), lambda: kind(vocabulary))
        for batch, first, end in by_bytes(batches, "_text", batch_bytes):
            part = batch.slice(first, end - first)
            texts = [x or "" for x in part.column("_text").to_pylist()]
            size = pc.fill_null(pc.binary_length(part.column("_text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("_id"), size, pa.array(counter.count(texts), pa.int64())],
                                             names=["_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    out = rows.mapInArrow(lengths, f"_id {rows.schema['_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > context).alias("over_limit"))
