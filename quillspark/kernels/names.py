"""Similar names within blocks: the indel ratio of one name against many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..operators.evaluate import indel_similarity

#: Longest name whose characters are bits of one word; pairs below which plain code is faster; rows of an output batch.
BITS, FEW, ROWS = 64, 256, 50_000


def _ratios(name: np.ndarray, others: np.ndarray, alphabet: int) -> np.ndarray:
    """Longest common subsequences of a name (codes from 1) with the columns of a matrix of codes, 0 where a name has ended."""
    table = np.zeros(alphabet + 1, np.uint64)
    np.bitwise_or.at(table, name, np.left_shift(np.uint64(1), np.arange(len(name), dtype=np.uint64)))
    mask = np.uint64((1 << len(name)) - 1)
    state = np.full(others.shape[1], mask)
    for row in table[others]:
        both = state & row
        state = ((state + both) | (state - both)) & mask
    return len(name) - np.bitwise_count(state).astype(np.int64)


def _met(left: list[str], right: list[str], same: bool, least: float, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, scores) of the pairs at or above `least`, whose lengths allow `near`."""

    def plain(pairs):
        for i, j in pairs:
            a, b = left[i], right[j]
            if 2 * min(len(a), len(b)) >= near * (len(a) + len(b)) and (score := indel_similarity(a, b)) >= least:
                yield i, j, score

    def arrays(found):
        i, j, score = zip(*found)
        return np.array(i), np.array(j), np.array(score)

    everything = [(i, j) for i in range(len(left)) for j in range(i + 1 if same else 0, len(right))] if len(left) * len(right) <= FEW else None
    if everything is not None:
        if found := list(plain(everything)):
            yield arrays(found)
        return
    sizes = np.array([len(n) for n in right])
    short = np.flatnonzero(sizes <= BITS)
    long = np.flatnonzero(sizes > BITS).tolist()
    letters = np.unique(np.array([ord(c) for c in set().union(*left, *right)], np.uint32))
    coded = lambda n: np.searchsorted(letters, np.frombuffer(n.encode("utf-32-le", "surrogatepass"), "<u4")) + 1
    codes = np.zeros((int(sizes[short].max(initial=0)), len(short)), np.int64)
    for k, j in enumerate(short.tolist()):
        codes[: sizes[j], k] = coded(right[j])
    for i, a in enumerate(left):
        if len(a) > BITS:
            rest = range(i + 1 if same else 0, len(right))
        else:
            k = int(np.searchsorted(short, i, side="right")) if same else 0
            size = sizes[short[k:]]
            total = size + len(a)
            score = 2 * _ratios(coded(a), codes[:, k:], len(letters)) / total
            hit = np.flatnonzero((score >= least) & (2 * np.minimum(size, len(a)) >= near * total))
            if len(hit):
                yield np.full(len(hit), i), short[k:][hit], score[hit]
            rest = [j for j in long if not same or j > i]
        if found := list(plain((i, j) for j in rest)):
            yield arrays(found)


def indel_pairs(units: pa.RecordBatch, least: float, near: float) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
    """(row of the unit, smaller name, larger name, score) of the similar pairs of units (group, same, left, right), in batches."""
    lefts, rights = units.column(2), units.column(3)
    pool = pa.concat_arrays([lefts.flatten(), rights.flatten()])
    at_left, at_right = ([o - c.offsets[0].as_py() for o in c.offsets.to_pylist()] for c in (lefts, rights))
    first = len(lefts.flatten())
    held: list[tuple] = []

    def flush():
        keys, a, b, score = map(np.concatenate, zip(*held))
        held.clear()
        for k in range(0, len(keys), ROWS):
            yield pa.array(keys[k : k + ROWS]), pool.take(pa.array(a[k : k + ROWS])), pool.take(pa.array(b[k : k + ROWS])), pa.array(score[k : k + ROWS])

    size = 0
    for unit, same in enumerate(units.column(1).to_pylist()):
        left = lefts[unit].as_py()
        right = left if same else rights[unit].as_py()
        # Places of the sorted names, so that a comparison of places is one of names.
        of_left = np.array(sorted(range(len(left)), key=left.__getitem__), np.int64)
        of_right = of_left if same else np.array(sorted(range(len(right)), key=right.__getitem__), np.int64)
        left = [left[k] for k in of_left]
        right = left if same else [right[k] for k in of_right]
        order = None if same else np.searchsorted(np.array(right, object), np.array(left, object))
        for i, j, score in _met(left, right, same, least, near):
            x = of_left[i] + at_left[unit]
            y = of_right[j] + (at_left[unit] if same else first + at_right[unit])
            # Names on the right before that place are smaller.
            swap = np.zeros(len(i), bool) if same else j < order[i]
            held.append((np.full(len(i), unit), np.where(swap, y, x), np.where(swap, x, y), score))
            size += len(i)
            if size >= ROWS:
                yield from flush()
                size = 0
    if held:
        yield from flush()
