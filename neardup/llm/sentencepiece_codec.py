"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is normalised as the vocabulary's model does it (a space mark before the
text, space marks for spaces) and cut into the pieces with the largest sum of
scores. A character without a piece costs ``UNKNOWN_PENALTY`` more than the worst
piece and is written as its UTF-8 byte pieces. Equal sums go to the longer last
piece.

The search reads one character after the other and keeps only a window: scores
of the boundaries that a piece can still reach (no more than the longest piece),
and backpointers since the last committed boundary. Ids are committed whenever
the backpointer paths of all boundaries in the window meet in one boundary; what
lies before it can't change any more. In most texts that happens at every space,
since no piece continues over it: the paths of a word meet at its ends. Words are
therefore looked up in a bounded dictionary of results and searched only when
new, many at once when they fit into one window (``windows``).

Decoding joins the pieces, turns byte pieces back into UTF-8 and marks into spaces.

Defined cases: a null or empty text has no ids and decodes to the empty text; a
text that holds the space mark itself decodes with spaces for it; every row is
coded by itself, so ties and repeated rows don't matter; an empty table gives an
empty result; other columns are kept unless they bear an output's name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from neardup.llm.bytewords import mix
from neardup.llm.common import by_bytes
from neardup.llm.vocab import Known, SentencePieces, kept_in_worker
from neardup.session import ship_by_value

ship_by_value(__name__)

UNKNOWN_PENALTY = 10.0
BATCH_BYTES = 1 << 20
#: Name of the worked-on column inside the functions; no input column may have it.
INPUT = "_neardup_input"
#: Window boundaries are compared for a common ancestor each time so many longest pieces are uncommitted.
PATIENCE = 4


class Codec:
    def __init__(self, name: str):
        self.pieces = SentencePieces(name)
        sp = self.pieces.library
        self.text: list[bytes] = []     # of each id, space marks as spaces
        self.byte: dict[int, int] = {}  # id of each byte piece
        self.vocabulary: dict[str, tuple[int, float] | None] = {}
        scores = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.text.append(p.replace(self.pieces.MARK, " ").encode())
                self.vocabulary[p] = (i, sp.get_score(i))
                scores.append(sp.get_score(i))
        self.longest = max(map(len, self.vocabulary))
        for p in list(self.vocabulary):
            for k in range(1, len(p)):
                self.vocabulary.setdefault(p[:k])
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.known = Known()
        self.tables = self.texts = None

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of the normalised ``text``, in the portions in which they are committed."""
        vocabulary, unknown, longest = self.vocabulary, self.unknown, self.longest
        best: dict[int, float] = {0: 0.0}            # of the boundaries in the window
        back: dict[int, tuple[int, int]] = {}        # boundary: where its last piece begins, and its id
        committed, reach = 0, 0                      # reach: the last boundary that any piece has reached
        wait = PATIENCE * longest
        n = len(text)
        for i in range(n):
            if i == reach and i > committed:         # no piece continues over i: all paths meet here
                yield self._walk(text, back, committed, i)
                back.clear()
                committed = i
            elif i - committed >= wait:
                meet = self._meeting(back, committed, range(i, reach + 1))
                if meet > committed:
                    yield self._walk(text, back, committed, meet)
                    back = {b: x for b, x in back.items() if b > meet}
                    committed = meet
                wait = i - committed + PATIENCE * longest
            score = best.pop(i)
            j = i + 1
            found = vocabulary.get(text[i:j], 0)
            if not found:                            # no piece of this one character: its bytes stand in
                total = score + unknown
                if j not in best or total > best[j]:
                    best[j], back[j] = total, (i, -1)
                    if j > reach:
                        reach = j
            while found != 0 and j <= n:
                if found:
                    total = score + found[1]
                    if j not in best or total > best[j]:
                        best[j], back[j] = total, (i, found[0])
                        if j > reach:
                            reach = j
                j += 1
                found = vocabulary.get(text[i:j], 0)
        if n:
            yield self._walk(text, back, committed, n)

    @staticmethod
    def _meeting(back: dict, committed: int, live: range) -> int:
        """The last boundary through which the paths of all live boundaries go."""
        paths = None
        for b in live:
            if b not in back:
                continue
            path = set()
            while b > committed:
                path.add(b)
                b = back[b][0]
            paths = path if paths is None else paths & path
        return max(paths, default=committed) if paths else committed

    def _walk(self, text: str, back: dict, first: int, last: int) -> list[int]:
        out: list[int] = []
        while last > first:
            last, piece, end = *back[last], last
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte[x] for x in reversed(text[last:end].encode())]
        out.reverse()
        return out

    def search(self, text: str) -> list[int]:
        """Ids of the normalised ``text``."""
        return [i for part in self.stream(text) for i in part]

    def _tables(self):
        """The hashes of the vocabulary's prefixes, the id (-1: only a prefix) and score of each, and a hash table of their places."""
        import numpy as np
        prefixes = list(self.vocabulary)
        hashed = np.zeros(len(prefixes), dtype=np.uint64)
        for k in range(self.longest):
            here = [i for i, p in enumerate(prefixes) if len(p) > k]
            chars = np.array([ord(prefixes[i][k]) for i in here], dtype=np.uint64)
            hashed[here] = mix(hashed[here] + chars + np.uint64(1))
        if len(np.unique(hashed)) < len(hashed):
            raise ValueError("two prefixes of the vocabulary have one hash")
        found = [self.vocabulary[p] or (-1, 0.0) for p in prefixes]
        slots = np.full(1 << (8 * len(hashed)).bit_length(), -1, dtype=np.int32)
        mask, waiting, probes = np.uint64(len(slots) - 1), np.arange(len(hashed)), 0
        while len(waiting):         # each goes to the first free slot from that of its hash on
            at = ((hashed[waiting] + np.uint64(probes)) & mask).astype(np.int64)
            free = np.flatnonzero(slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            slots[at[free[first]]] = waiting[free[first]]
            waiting = np.delete(waiting, free[first])
            probes += 1
        return hashed, np.array([f[0] for f in found]), np.array([f[1] for f in found]), slots, probes

    def _find(self, prefix):
        """(place in the tables, whether it is there) of each hashed prefix."""
        import numpy as np
        hashes, _, _, slots, probes = self.tables
        mask = np.uint64(len(slots) - 1)
        at = slots[(prefix & mask).astype(np.int64)]
        known = hashes[at] == prefix
        known &= at >= 0
        other = np.flatnonzero((at >= 0) & ~known)
        for k in range(1, probes):
            if not len(other):
                break
            here = slots[((prefix[other] + np.uint64(k)) & mask).astype(np.int64)]
            hit = (here >= 0) & (hashes[here] == prefix[other])
            at[other[hit]], known[other[hit]] = here[hit], True
            other = other[(here >= 0) & ~hit]
        return at, known

    def windows(self, texts: list[str]) -> list[bytes | None]:
        """The same search for many texts that fit into one window each, all in step.

        Nothing can be committed before the end of such a text. None stands for a
        text with a character that isn't a piece; ``search`` has its bytes.
        """
        import numpy as np
        if not texts:
            return []
        if self.tables is None:
            self.tables = self._tables()
        _, ids, scores, _, _ = self.tables
        n, lens = len(texts), np.array([len(t) for t in texts])
        width = int(lens.max())
        chars = np.zeros((n, width), dtype=np.uint64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        inside = np.arange(width) < lens[:, None]
        chars[inside] = flat
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0.0
        begin = np.zeros((n, width + 1), dtype=np.int64)
        last = np.zeros((n, width + 1), dtype=np.int64)
        whole = np.ones(n, dtype=bool)
        for i in range(width):
            rows = np.flatnonzero(lens > i)
            prefix = np.zeros(len(rows), dtype=np.uint64)
            for j in range(i, width):
                prefix = mix(prefix + chars[rows, j] + np.uint64(1))
                at, known = self._find(prefix)
                piece = np.where(known, ids[at], -1)
                if j == i:
                    whole[rows[piece < 0]] = False
                hit = np.flatnonzero(piece >= 0)
                r = rows[hit]
                total = best[r, i] + scores[at[hit]]
                better = total > best[r, j + 1]
                r, hit = r[better], hit[better]
                best[r, j + 1], begin[r, j + 1], last[r, j + 1] = total[better], i, piece[hit]
                more = known & (lens[rows] > j + 1)
                rows, prefix = rows[more], prefix[more]
                if not len(rows):
                    break
        place, steps, all_rows = lens.copy(), [], np.arange(n)
        while (place > 0).any():
            steps.append(np.where(place > 0, last[all_rows, place], -1))
            place = np.where(place > 0, begin[all_rows, place], 0)
        back = np.stack(steps[::-1], axis=1)
        used = back >= 0
        ends = np.cumsum(used.sum(axis=1)) * 4
        data = back[used].astype("<i4").tobytes()
        return [data[a:b] if ok else None for a, b, ok in zip([0, *ends.tolist()], ends.tolist(), whole.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian signed 32-bit integers."""
        import numpy as np
        known = self.known
        if self.pieces.splits:
            split = [self.pieces.pieces(t) for t in texts]
        else:
            split = [[(" " + t).replace(" ", self.pieces.MARK)] if t else [] for t in texts]
        missing = known.missing(set().union(*split))
        short = [p for p in missing if len(p) <= self.longest]
        known.update(zip(short, self.windows(short)))
        for p in missing:
            if known.get(p) is None:
                known[p] = np.array(self.search(p), dtype="<i4").tobytes()
        out = [b"".join([known[p] for p in x]) for x in split]
        known.forget()
        return out

    def decode(self, ids) -> str:
        """The text of ``ids`` (a list or an array); broken UTF-8 becomes replacement characters."""
        import numpy as np
        if self.texts is None:
            self.texts = np.array(self.text, dtype=object)
        return b"".join(self.texts[np.asarray(ids, dtype=np.int64)].tolist()).decode("utf-8", "replace")[1:]


def _columns(docs: DataFrame, new: list[str]) -> list[str]:
    return [f"`{c}`" for c in docs.columns if c not in new]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with ids (array<int>) and n_ids of each whole text."""
    def coded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        codec = kept_in_worker(("codec", vocabulary), lambda: Codec(vocabulary))
        for batch, first, end in by_bytes(batches, INPUT, batch_bytes):
            part = batch.slice(first, end - first)
            ids = codec.encode([x or "" for x in part.column(INPUT).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names[1:]), lists],
                                             names=[*part.schema.names[1:], "ids"])

    rows = docs.select(F.col(text).alias(INPUT), *_columns(docs, ["ids", "n_ids", INPUT]))
    schema = rows.drop(INPUT).schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(coded, schema).withColumn("n_ids", F.size("ids").cast("bigint"))


def decode(coded: DataFrame, vocabulary: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids; null ids give null."""
    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa
        codec = kept_in_worker(("codec", vocabulary), lambda: Codec(vocabulary))
        for batch in batches:
            out = [None if x is None else codec.decode(x) for x in batch.column(INPUT).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[1:]), pa.array(out, pa.string())],
                                             names=[*batch.schema.names[1:], to])

    rows = coded.select(F.col(ids).alias(INPUT), *_columns(coded, [to, INPUT]))
    return rows.mapInArrow(texts, rows.drop(INPUT).schema.add(to, "string"))


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` with ids, n_ids and same: whether the ids decode to the text again (null as empty).

    ``encode`` and ``decode`` in one pass of the workers, so the ids travel once.
    """
    def coded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        codec = kept_in_worker(("codec", vocabulary), lambda: Codec(vocabulary))
        for batch, first, end in by_bytes(batches, INPUT, batch_bytes):
            part = batch.slice(first, end - first)
            texts = [x or "" for x in part.column(INPUT).to_pylist()]
            ids = codec.encode(texts)
            same = [codec.decode(np.frombuffer(i, "<i4")) == t for t, i in zip(texts, ids)]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names[1:]), lists, pa.array(same)],
                                             names=[*part.schema.names[1:], "ids", "same"])

    rows = docs.select(F.col(text).alias(INPUT), *_columns(docs, ["ids", "n_ids", "same", INPUT, text]))
    schema = rows.drop(INPUT).schema.add("ids", T.ArrayType(T.IntegerType())).add("same", "boolean")
    return rows.mapInArrow(coded, schema).withColumn("n_ids", F.size("ids").cast("bigint"))
