"""Words of many texts as numpy arrays, without a Python object for each word."""

from __future__ import annotations

from neardup.session import ship_by_value

ship_by_value(__name__)

SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes worked on at once; longer texts are cut at a separator.
CHUNK = 1 << 21


def mix(x):
    """Finaliser of splitmix64 on unsigned 64-bit numpy integers."""
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_set(members: bytes):
    import numpy as np
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


def bounds(octets):
    """(starts, ends) of the words: maximal runs without a byte of SEPARATORS."""
    import numpy as np
    inside = np.zeros(len(octets) + 2, dtype=np.int8)
    inside[1:-1] = ~byte_set(SEPARATORS)[octets]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Hasher:
    """64-bit hashes of words: a polynomial of random byte values in a random odd base, then ``mix``."""

    def __init__(self, seed: int = 20):
        import numpy as np
        r = np.random.default_rng(seed)
        self.values = r.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(r.integers(0, 1 << 64, dtype=np.uint64)) | 1
        self.powers = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int):
        import numpy as np
        while len(self.powers) < n:
            top = np.uint64(pow(self.base, len(self.powers), 1 << 64))
            self.powers = np.concatenate([self.powers, self.powers * top])
        return self.powers

    def hashes(self, octets, starts, ends, keep=None):
        """A hash for each word [start, end); bytes where ``keep`` is False don't count (a word of none: 0)."""
        import numpy as np
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        lens = ends - starts
        at = np.arange(int(lens.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
        firsts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        values = self.values[octets[at]]
        if keep is None:
            place = at - np.repeat(starts, lens)
            count = lens
        else:
            kept = keep[at].astype(np.int64)
            before = np.cumsum(kept) - kept
            place = before - np.repeat(before[firsts], lens)
            values = values * kept.astype(np.uint64)
            count = np.add.reduceat(kept, firsts)
        total = np.add.reduceat(values * self._powers(int(place.max()) + 1)[place], firsts)
        return np.where(count > 0, mix(total + count.astype(np.uint64)), np.uint64(0))


def chunks(texts: list[bytes]):
    """(text number of each chunk's texts, joined bytes, offset of each) of about CHUNK bytes.

    Texts are joined by a space; one longer than CHUNK comes in several chunks cut
    at a separator, so no word is divided.
    """
    held, numbers, size = [], [], 0
    for i, t in enumerate(texts):
        while len(t) > CHUNK:
            cut = max(t.rfind(bytes([s]), 0, CHUNK) for s in SEPARATORS)
            if cut < 0:
                cut = min([x for x in (t.find(bytes([s]), CHUNK) for s in SEPARATORS) if x >= 0], default=len(t))
            if held:
                yield numbers, held
                held, numbers, size = [], [], 0
            yield [i], [t[:cut]]
            t = t[cut:]
        held.append(t)
        numbers.append(i)
        size += len(t) + 1
        if size >= CHUNK:
            yield numbers, held
            held, numbers, size = [], [], 0
    if held:
        yield numbers, held


def word_hashes(texts: list[bytes], hasher: Hasher):
    """(hashes of all words in order, number of words of each text)."""
    import numpy as np
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    for numbers, held in chunks(texts):
        octets = np.frombuffer(b" ".join(held), dtype=np.uint8)
        starts, ends = bounds(octets)
        out.append(hasher.hashes(octets, starts, ends))
        begin = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
        np.add.at(counts, np.asarray(numbers)[np.searchsorted(begin, starts, side="right") - 1], 1)
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), counts
