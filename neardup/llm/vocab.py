"""Tokenizer files and the boundaries at which a text may be split for them.

``SentencePieces`` and ``ByteLevel`` turn a text into short pieces whose ids,
one piece after the other, are those of the whole text. Both keep the results of
frequent pieces in a bounded dictionary, so that a word is encoded by the
library once and looked up afterwards.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from neardup.session import ship_by_value

ship_by_value(__name__)

#: Pieces remembered by one worker, and the longest one that is remembered.
CACHE_PIECES = 1_000_000
CACHE_CHARS = 64


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gave for ``key``, kept by this worker process for its next tasks; one object at a time."""
    import sys
    import types
    state = sys.modules.setdefault("neardup_worker_state", types.ModuleType("neardup_worker_state")).__dict__
    if state.get("key") != key:
        state.pop("value", None)
        state["key"], state["value"] = key, make()
    return state["value"]


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare name is a file of the installed ``public_tokenizers``."""
    if os.path.basename(name) != name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Known(dict):
    """Results by piece. Grows by the pieces of one slice of texts at most beyond ``CACHE_PIECES``."""

    long: list[str] = []

    def missing(self, pieces: set[str]) -> list[str]:
        new = list(pieces.difference(self))
        self.remember(new)
        return new

    def remember(self, new: list[str]) -> None:
        """Notes which of the pieces about to be added are long."""
        self.long = self.long + [p for p in new if len(p) > CACHE_CHARS]

    def forget(self) -> None:
        """Called between slices: drops its long pieces, and everything once the bound is passed."""
        for p in self.long:
            self.pop(p, None)
        self.long = []
        if len(self) > CACHE_PIECES:
            self.clear()


class SentencePieces:
    """Pieces of a text for a SentencePiece model, as (key, text handed to the library).

    No vocabulary piece holds a space mark after another character or a line feed
    at all, so no merge crosses the place before a run of spaces or either side of
    a line feed. That is checked when the model is loaded, as is that the model's
    normaliser changes nothing; otherwise ``pieces`` gives the whole text.
    """

    MARK = "▁"

    def __init__(self, name: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        vocabulary = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        probe = "  ﬁ x  éé "
        self.splits = (not any(self.MARK in p.lstrip(self.MARK) or "\n" in p for p in vocabulary)
                       and self.library.normalize(probe) == (" " + probe).replace(" ", self.MARK))

    def pieces(self, text: str) -> list[str]:
        """Parts of the normalised text (space marks for spaces); each but a line feed stands alone."""
        if self.MARK in text:
            text = text.replace(self.MARK, " ")
        out: list[str] = []
        if not text:
            return out
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out.append("\n")
            if "" in words and len(words) > 1:  # several spaces in a row, or some at an end
                marked = line.replace(" ", self.MARK) if k else self.MARK + line.replace(" ", self.MARK)
                out += re.findall(f"{self.MARK}+[^{self.MARK}]*|[^{self.MARK}]+", marked)
                continue
            if k:
                if words[0]:
                    out.append(words[0])
                del words[0]
            elif words == [""]:
                out.append(self.MARK)
                continue
            out += [self.MARK + w for w in words]
        return out


class ByteLevel:
    """Ids of texts for a byte-level BPE file whose words are split by the usual byte-level pattern.

    A single space between two characters that aren't white space begins a word of
    that pattern, and a single line feed between such characters is a word of its
    own; so lines and words can be encoded one by one. Texts with other white
    space are split only at the single spaces.
    """

    OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
    SINGLE = re.compile(r"(?<=\S) (?=\S)")
    JOINED = 32
    CUT = 1 << 18

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.words = Known()   # after a space
        self.heads = Known()   # at the beginning of a line
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.octets = np.zeros(size, dtype=np.int64)   # of each id: one byte for each character of its token
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.octets[i] = len(token)
        for i, token in self.library.get_added_tokens_decoder().items():
            self.octets[i] = len(token.content.encode())
        self.feed = self._ids(["\n"], "")[0]
        self.tails = {c: self._ids([c], "")[0] for c in ".,"}

    def _ids(self, pieces: list[str], between: str) -> list[bytes]:
        """Ids of each piece. JOINED pieces at a time make one input, which saves most of the library's call costs.

        ``between`` parts the pieces where they don't begin with a space; it is a word of its own.
        """
        import numpy as np
        inputs = [between.join(pieces[k:k + self.JOINED]) for k in range(0, len(pieces), self.JOINED)]
        got = [np.array(x.ids, dtype="<u4") for x in self.library.encode_batch_fast(inputs, add_special_tokens=False)]
        if not got:
            return []
        ids = np.concatenate(got)
        ends = np.cumsum(self.octets[ids])             # the byte of the joined inputs at which each id ends
        sizes = np.array([len(p.encode()) for p in pieces]) + len(between)
        sizes[self.JOINED - 1::self.JOINED] -= len(between)
        if len(pieces) % self.JOINED:
            sizes[-1] -= len(between)
        last = np.searchsorted(ends, np.cumsum(sizes)) + 1
        first = np.concatenate([[0], last[:-1]])
        apart = np.full(len(pieces), len(between))     # its one id comes last in the piece's share
        apart[self.JOINED - 1::self.JOINED] = 0
        apart[-1] = 0
        data = ids.tobytes()
        return [data[4 * a:4 * b] for a, b in zip(first.tolist(), (last - apart).tolist())]

    def _learn(self, known: Known, new: set[str], before: str) -> None:
        """Add the ids of ``new`` pieces; a final stop or comma after a letter is a word by itself."""
        tails, cores, tailed = self.tails, set(), []
        for w in new:
            if w[-1:] in tails and w[-2:-1].isalpha():
                tailed.append(w)
                w = w[:-1]
                if w in known:
                    continue
            cores.add(w)
        pieces = list(cores)
        known.remember(pieces)
        known.remember(tailed)
        known.update(zip(pieces, self._ids([before + w for w in pieces], "" if before else "\n")))
        known.update([(w, known[w[:-1]] + tails[w[-1]]) for w in tailed])

    def _whole(self, text: str) -> bytes:
        """Ids of a text with unusual white space, in parts of about CUT characters cut before single spaces."""
        import numpy as np
        parts, at = [], 0
        while len(text) - at > self.CUT and (m := self.SINGLE.search(text, at + self.CUT)):
            parts.append(text[at:m.start()])
            at = m.start()
        parts.append(text[at:])
        return b"".join(np.array(x.ids, dtype="<u4").tobytes()
                        for x in self.library.encode_batch_fast(parts, add_special_tokens=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        words, heads = self.words, self.heads
        known = words.get
        # of each text its lines: words after the first one, their ids, and which of them are still unknown
        split: list[list[tuple[str, list[str], list, list[int]]] | None] = []
        new_words: set[str] = set()
        new_heads: set[str] = set()
        for t in texts:
            lines = [x.split(" ") for x in t.split("\n")]
            if t == "" or any("" in x for x in lines) or self.OTHER_SPACE.search(t):
                split.append(None)
                continue
            rows = []
            for x in lines:
                head = x[0]
                del x[0]
                if head not in heads:
                    new_heads.add(head)
                ids = list(map(known, x))
                unknown = [k for k, i in enumerate(ids) if i is None]
                if unknown:
                    new_words.update([x[k] for k in unknown])
                rows.append((head, x, ids, unknown))
            split.append(rows)
        self._learn(words, new_words, " ")
        self._learn(heads, new_heads, "")
        out = []
        for t, rows in zip(texts, split):
            if rows is None:
                out.append(self._whole(t))
                continue
            parts = []
            for head, x, ids, unknown in rows:
                for k in unknown:
                    ids[k] = words[x[k]]
                parts.append(heads[head] + b"".join(ids))
            out.append(self.feed.join(parts))
        words.forget()
        heads.forget()
        return out
