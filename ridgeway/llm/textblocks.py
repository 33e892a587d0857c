"""Words, lines and their 64-bit hashes over whole Arrow text columns, in numpy.

A hash of bytes [s, e) is read off one running sum of ``T[byte] * B**position`` (modulo 2**64): the
difference of two sums times ``B**-s``, then mixed.  No Python object is made per word, and rows are
taken in blocks of bounded size (one longer text makes a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), _BASE if kind == "up" else _BASE_INV)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Consecutive rows ``first .. first + n`` of a batch."""

    first: int
    n: int
    data: np.ndarray  # bytes
    at: np.ndarray  # n + 1 offsets into data

    def lowered(self) -> "Block":
        return Block(self.first, self.n, _LOWER[self.data], self.at)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), which come in order and don't overlap.

        A hash depends on its bytes only, not on where they lie, so long data is taken in pieces of about ``BLOCK_BYTES``
        that end between two items: the sums of a piece are all that is held at a time.
        """
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK_BYTES, side="right")))
            piece = self.data[start[i] : end[j - 1]]
            s, e = start[i:j] - start[i], end[i:j] - start[i]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[piece] * _power("up", len(piece))[: len(piece)], out=sums[1:])
            out[i:j] = mix((sums[e] - sums[s]) * _power("down", len(piece) + 1)[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (from 0 in the block), start and end of every maximal run of bytes other than ASCII white space."""
        starts, ends, at = [], [], 0
        while at < len(self.data):
            stop = min(len(self.data), at + BLOCK_BYTES)
            word = ~_SPACE[self.data[max(at - 1, 0) : stop + 1]]  # with the byte before and the one after
            here = word[at > 0 : (at > 0) + stop - at]
            before = np.concatenate([word[:1] if at else [False], here[:-1]])
            after = np.concatenate([here[1:], word[-1:] if stop < len(self.data) else [False]])
            first, last = (self.at[(self.at >= low) & (self.at < stop + low - at)] - low for low in (at, at + 1))
            before[first[first < len(here)]] = False  # a row starts here
            after[last[last < len(here)]] = False  # and one ends here
            starts.append(np.flatnonzero(here & ~before) + at)
            ends.append(np.flatnonzero(here & ~after) + at + 1)
            at = stop
        start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        return np.searchsorted(self.at, start, side="right") - 1, start, end

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Row, start and end of every ``\n``-separated line; an empty text has one empty line."""
        cut = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.at[:-1], cut + 1])
        row = np.concatenate([np.arange(self.n), np.searchsorted(self.at, cut, side="right") - 1])
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        end = np.empty(len(start), np.int64)
        end[:-1] = np.where(row[1:] == row[:-1], start[1:] - 1, self.at[row[:-1] + 1])
        if len(end):
            end[-1] = self.at[-1]
        return row, start, end

    def count(self, flag: np.ndarray) -> np.ndarray:
        """How many positions of each row are flagged."""
        total = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def text(self, row: int) -> str:
        return self.data[self.at[row] : self.at[row + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string column in order; a null is an empty text."""
    if len(column) == 0:
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield Block(i, j - i, data[at[i] : at[j]], (at[i : j + 1] - at[i]).astype(np.int64))
        i = j


def windows(row: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first word, and hash, of every run of ``size`` words within one row."""
    n = len(row) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total + hashes[k : k + n] + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1))
    keep = np.flatnonzero(row[:n] == row[size - 1 :])
    return keep, total[keep]


def repeats(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks over items: its hash occurs more than once in its row; it is a later occurrence."""
    n = len(row)
    key = mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(n, bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    later = np.zeros(n, bool)
    later[order] = same
    any_ = same.copy()
    any_[:-1] |= same[1:]
    twice = np.zeros(n, bool)
    twice[order] = any_
    return twice, later
