"""Fingerprints of one bucket compared by numpy's exclusive or and bit counts, within Spark's partitions.

``near_pairs`` gets the rows of a partition in order of ``place``, a hash of their tiles (band, key, low, high) whose last bit is the
side; so within a tile the left rows come first, and tiles that share a hash are sorted apart here. It compares each left row with every right row of its tile, in a tile of one block with itself (low = high) also
with the left rows after it. Small tiles are compared together, large ones in cuts of ``CUT`` comparisons. A task holds one
tile (its size is bounded by who makes the tiles), an Arrow batch and a cut.

``near_links`` gets the same rows and returns only links that connect what is near in a tile, fewer than the tile has rows. In a
large tile some rows are compared with all others first; rows that are connected so are one group and aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from neardup.session import ship_by_value

ship_by_value(__name__)

#: Comparisons of small tiles held at once, and from how many on a tile is compared by itself.
CELLS, ALONE = 1 << 18, 1 << 12
#: Comparisons of a large tile held at once, right rows among them, and near pairs handed on together.
CUT, COLUMNS, HANDED = 1 << 16, 1 << 14, 1 << 14
#: Rows from which on a tile's groups are sought first, rows compared with all others for that, and rows of a group that counts.
LEADERS_FROM, LEADERS, GROUP = 2_048, 48, 64
#: Pairs of an output batch.
PAIRS_OUT = 1 << 16
TILE = ("band", "key", "low", "high")


def _numbers(table: pa.Table, column: str):
    return table.column(column).to_numpy()


def _starts(columns: list):
    changed = np.zeros(len(columns[0]), dtype=bool)
    changed[0] = True
    for values in columns:
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _place_starts(table: pa.Table):
    return _starts([_numbers(table, "place") >> 1])


def _by_tile(table: pa.Table) -> tuple:
    """``table`` in order of its tiles, and their first rows."""
    starts = _starts([_numbers(table, c) for c in TILE])
    runs = _place_starts(table)
    # fewer hashes than tiles, or a run that another tile's rows cut in pieces
    if len(starts) != len(runs):
        side = _numbers(table, "place") & 1
        table = table.take(pa.array(np.lexsort([side, *(_numbers(table, c) for c in reversed(TILE))])))
        starts = _starts([_numbers(table, c) for c in TILE])
    return table, starts


def _lead(words: list) -> list:
    return words[:min(3, (len(words) + 1) // 2)]         # counts of three words fit a byte


def _dense(left: list, right: list, threshold: int, own: bool) -> Iterator[tuple]:
    """(u, v): places of the pairs of ``left`` and ``right`` near in these words; ``own``: ``left`` begins ``right`` and u < v."""
    n, m = len(left[0]), len(right[0])
    if not n or not m:
        return
    cols = min(m, COLUMNS)
    rows = min(n, max(1, CUT // cols))
    differ, apart, more, near = (np.empty((rows, cols), dtype=t) for t in (np.uint64, np.uint8, np.uint8, bool))
    held, n_held = [], 0
    for i in range(0, n, rows):
        to = min(n, i + rows)
        for j in range(i + 1 if own else 0, m, cols):
            end = min(m, j + cols)
            at = (slice(0, to - i), slice(0, end - j))
            for k, (a, b) in enumerate(zip(left, right)):
                np.bitwise_xor(a[i:to, None], b[None, j:end], out=differ[at])
                np.bitwise_count(differ[at], out=(more if k else apart)[at])
                if k:
                    np.add(apart[at], more[at], out=apart[at])
            met = np.flatnonzero(np.less_equal(apart[at], threshold, out=near[at]))
            if not len(met):
                continue
            u, v = np.divmod(met, end - j)
            u, v = u + i, v + j
            if own and j < to:
                u, v = u[u < v], v[u < v]
            held.append((u, v))
            n_held += len(u)
            if n_held >= HANDED:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n_held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _parts(parent, start: int, end: int, n: int, own: bool) -> Iterator[tuple]:
    """(left places, right places, own): the comparisons of a tile but those of two rows of one group of GROUP rows or more."""
    left, right = np.arange(start, start + n), np.arange(start + n, end)
    groups, of, size = np.unique(parent[start:end], return_inverse=True, return_counts=True)
    label = np.where(size >= GROUP, np.arange(len(groups)), len(groups))[of]
    mine, theirs = label[:n], label[n:]
    for g in np.flatnonzero(size >= GROUP):
        others = [left[mine > g]] if own else []
        yield left[mine == g], np.concatenate([*others, right[theirs != g]]), False
    rest = left[mine == len(groups)]
    yield rest, np.concatenate([rest, right]) if own else right, own


def _candidates(words, starts, ends, lefts, alone, threshold: int, parent=None) -> Iterator[tuple]:
    """(u, v): places of the pairs that are near in the first half of the words; with ``parent`` but those of one group."""
    lead = _lead(words)

    def near(cut):
        out = None
        for w in lead:
            apart = np.bitwise_count(cut(w))
            out = apart if out is None else out + apart
        return out <= threshold

    large = lefts * (ends - starts) >= ALONE
    for start, end, n, own in zip(starts[large], ends[large], lefts[large], alone[large]):
        if parent is not None and end - start >= LEADERS_FROM:
            _join_leaders(words, start, end, threshold, parent)
            parts = _parts(parent, start, end, n, own)
        else:
            parts = [(np.arange(start, start + n), np.arange(start if own else start + n, end), own)]
        for left, right, same in parts:
            for u, v in _dense([w[left] for w in lead], [w[right] for w in lead], threshold, same):
                yield left[u], right[v]

    few = ~large & (lefts > 0)
    starts, ends, lefts, alone = starts[few], ends[few], lefts[few], alone[few]
    if not len(starts):
        return
    total = lefts.sum()
    place = np.arange(total) - np.repeat(np.cumsum(lefts) - lefts, lefts) + np.repeat(starts, lefts)
    other = np.where(np.repeat(alone, lefts), place + 1, np.repeat(starts + lefts, lefts))
    count = np.repeat(ends, lefts) - other
    upto = np.cumsum(count)
    first = 0
    while first < total:
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + CELLS, side="right")))
        n = count[first:last]
        u = np.repeat(place[first:last], n)
        v = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(other[first:last], n)
        found = np.flatnonzero(near(lambda w: w[u] ^ w[v]))
        yield u[found], v[found]
        first = last


def _join(parent, u, v) -> None:
    """Connects u and v in ``parent``, where each row has the first one of its group."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if not len(u):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _join_leaders(words: list, start: int, end: int, threshold: int, parent) -> None:
    """Connects what is within ``threshold`` of some rows of the tile."""
    for x in np.unique(np.linspace(start, end - 1, LEADERS).astype(np.int64)):
        apart = sum(np.bitwise_count(w[start:end] ^ w[x]).astype(np.int16) for w in words)
        near = np.flatnonzero(apart <= threshold)
        _join(parent, near + start, np.full(len(near), x))


def _tiles(table: pa.Table, n_words: int) -> tuple:
    """``table`` in order of its tiles, its words, and of each tile the first row, the end, the left rows and whether it is of one block."""
    table, starts = _by_tile(table)
    words = [_numbers(table, f"w{k}").view(np.uint64) for k in range(n_words)]
    right = _numbers(table, "place") & 1
    ends = np.append(starts[1:], table.num_rows)
    lefts = ends - starts - np.add.reduceat(right, starts)
    alone = _numbers(table, "low")[starts] == _numbers(table, "high")[starts]
    return table, words, starts, ends, lefts, alone


def _links_of(table: pa.Table, n_words: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Links between the rows of whole tiles and the smallest id of their groups."""
    table, words, *tiles = _tiles(table, n_words)
    parent = np.arange(table.num_rows)
    for u, v in _candidates(words, *tiles, threshold, parent):
        within = sum(np.bitwise_count(w[u] ^ w[v]).astype(np.int32) for w in words) <= threshold
        _join(parent, u[within], v[within])
    linked = np.flatnonzero(np.bincount(parent, minlength=len(parent))[parent] > 1)
    if not len(linked):
        return
    ids = table.column("id").combine_chunks().take(pa.array(linked))
    order = pc.array_sort_indices(ids).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    least = np.full(len(parent), len(order))
    np.minimum.at(least, parent[linked], rank)
    to = order[least[parent[linked]]]
    at = np.flatnonzero(to != np.arange(len(to)))
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), ids.take(pa.array(to[at]))], names=["x", "y"])


def _pairs_of(table: pa.Table, n_words: int, threshold: int, bands: list, across: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of whole tiles: ``bands`` has (band, masks of the words, radius) in order; a pair counts in the first band within its radius."""
    table, words, starts, ends, lefts, alone = _tiles(table, n_words)
    band = _numbers(table, "band")
    ids = table.column("id").combine_chunks()
    group = table.column("comp").combine_chunks().dictionary_encode().indices.to_numpy() if across else None

    held, n_held = [], 0
    for u, v in _candidates(words, starts, ends, lefts, alone, threshold):
        differ = [w[u] ^ w[v] for w in words]
        apart = sum(np.bitwise_count(x).astype(np.int32) for x in differ)
        keep = apart <= threshold
        if across:
            keep &= group[u] != group[v]
        first = np.full(len(u), -1)
        for i, masks, radius in reversed(bands):
            within = sum(np.bitwise_count(x & np.uint64(m)).astype(np.int32) for x, m in zip(differ, masks)) <= radius
            first[within] = i
        keep &= first == band[u]
        if keep.any():
            held.append((u[keep], v[keep], apart[keep]))
            n_held += int(keep.sum())
        if n_held >= PAIRS_OUT:
            yield _batch(ids, held)
            held, n_held = [], 0
    if held:
        yield _batch(ids, held)


def _batch(ids, held: list) -> pa.RecordBatch:
    u, v, apart = (np.concatenate(x) for x in zip(*held))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v)), pa.array(apart, pa.int32())],
                                      names=["x", "y", "distance"])


def _by_whole_tiles(of_tables):
    """A function for ``mapInArrow`` that gives ``of_tables`` tables of whole tiles."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
            last = int(_place_starts(table)[-1])
            held = table.slice(last)
            if last:
                yield from of_tables(table.slice(0, last))
        if held is not None:
            yield from of_tables(held)
    return compare


def near_pairs(n_words: int, threshold: int, bands: list, across: bool):
    """A function for ``mapInArrow``: (x, y, distance) of the pairs within ``threshold``; ``across``: of different comp only."""
    return _by_whole_tiles(lambda table: _pairs_of(table, n_words, threshold, bands, across))


def near_links(n_words: int, threshold: int):
    """A function for ``mapInArrow``: (x, y) links that connect in each tile what pairs within ``threshold`` connect."""
    return _by_whole_tiles(lambda table: _links_of(table, n_words, threshold))
