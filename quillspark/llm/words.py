"""Words of many texts at once, straight from Arrow's buffers: a batch of texts is one array of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes lie in the given ranges, both ends included."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of UTF-8 from 0x80 on belong to characters beyond ASCII.
LETTERS = byte_class((ord("A"), ord("Z")), (ord("a"), ord("z")), (0x80, 0xFF))
LETTERS_DIGITS = LETTERS | byte_class((ord("0"), ord("9")))


@dataclass
class Words:
    """Words of texts laid end to end: ``data`` in lower case, with eight zeros behind; ``start`` and ``end`` of each
    word in it, and the text ``row`` that it is in. ``bounds``: where texts begin, and the last one's end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    bounds: np.ndarray

    def keys(self, which: np.ndarray | slice, depth: np.ndarray | int = 0) -> np.ndarray:
        """Eight bytes of words from ``depth`` on as big-endian numbers, zeros beyond their ends."""
        at = self.start[which] + depth
        left = np.clip(self.end[which] - at, 0, 8).astype(np.uint64)
        rolling = np.lib.stride_tricks.as_strided(self.data[:8].view(">u8"), (len(self.data) - 7,), (1,))
        shift = np.uint64(64) - np.uint64(8) * left
        got = rolling[np.minimum(at, len(self.data) - 8)].astype(np.uint64)
        return np.where(left == 0, np.uint64(0), got >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)))

    def text(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode()


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, bounds)`` of a string column; null texts are empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, bounds - bounds[0]


def find_words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes ``inside``; none crosses from one text to the next."""
    n = len(data)
    hit = np.zeros(n + 2, dtype=bool)
    hit[1:-1] = inside[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(hit[1:] & (~hit[:-1] | edge))
    end = np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(np.concatenate([LOWER[data], np.zeros(8, dtype=np.uint8)]), start, end, row, bounds)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``size`` bytes together; a longer text is one of its own."""
    _, bounds = texts_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
