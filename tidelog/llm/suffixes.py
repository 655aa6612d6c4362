"""What the suffix arrays share: multikey sorting of fixed-width suffixes, and hashes of their rows."""

from __future__ import annotations

import numpy as np

from tidelog.llm import common


def multikey(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of characters (uint64 columns) in order, and the longest common prefix of each with the one before.

    A multikey quicksort by levels: all rows by the first character, then each run of equal ones by
    the next; a row that stands alone is in its place. Prefixes are counted in characters.
    """
    order, common_prefix = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    at, run = np.arange(len(rows)), np.zeros(len(rows), np.int64)  # places still to be sorted, and the run of each
    for c in range(rows.shape[1]):
        if not len(at):
            break
        x = rows[order[at], c]
        by = np.lexsort((x, run))
        x = x[by]
        order[at] = order[at][by]
        same_run = np.r_[False, run[1:] == run[:-1]]  # runs keep their places
        equal = same_run & np.r_[False, x[1:] == x[:-1]]
        common_prefix[at[equal]] = c + 1
        run = np.cumsum(~equal) - 1
        together = np.bincount(run)[run] > 1
        at, run = at[together], run[together]
    return order, common_prefix


def groups(rows: np.ndarray) -> np.ndarray:
    """The group of each row, equal rows' alike: neighbours in the sorted order that share all characters."""
    order, prefix = multikey(rows)
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(prefix < rows.shape[1]) - 1
    return group


def row_hash(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each row of uint64 columns."""
    with np.errstate(over="ignore"):
        h = np.full(len(rows), (seed * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for c in range(rows.shape[1]):
            h = common.mix(h * np.uint64(0xD1342543DE82EF95) + rows[:, c])
    return h


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct row, and the number of its distinct row for every row; rows are told apart by 128 bits."""
    return numbered(row_hash(rows), row_hash(rows, 1))


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """distinct() of rows of which only two hashes are at hand."""
    order = np.lexsort((b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(order) else np.empty(0, bool)
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


#: Places looked at at once by minima(); the place of a minimum takes 24 bits.
STEP = 1 << 22


def minima(h: np.ndarray, span: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the least of every span hashes in a row, each once, and the first and last start of the rows it is the least of."""
    found = [_minima(h[at : at + step + span - 1], span, at) for at in range(0, max(1, len(h) - span + 1), step)]
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _minima(h: np.ndarray, span: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(h) < span:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    where = least_places(h, span)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    return where[first] + at, first + at, np.r_[first[1:], len(where)] - 1 + at


def least_places(h: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of the span hashes from each place on."""
    place, width = np.uint64((1 << 24) - 1), 1
    least = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(h) - span + 1], least[span - width :])
    return (least & place).astype(np.int64)
