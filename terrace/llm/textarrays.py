"""Words of whole Arrow text columns as numpy arrays of 64-bit hashes.

One batch of texts is one byte buffer with row offsets; every step below is a numpy
operation over that buffer, so no Python code runs per word. Slices of a bounded
number of bytes keep memory flat whatever the texts' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
_BYTES = np.arange(256)
#: Words are split at blank and 0x09-0x0D ...
BLANK = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: ... or, for matching passages whatever their punctuation, at every ASCII character but letters and digits.
NOT_ALNUM = ~np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The low bytes of a 64-bit word, by how many count.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word beyond which it is hashed by itself.
_LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (a multiply and xor-shift finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` text bytes, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    total = np.cumsum(size)
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the row offsets into them. A null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and row offsets into the words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lower-cased, and row offsets into them."""
    data, offsets = raw(column)
    starts, ends, rows = spans(data, offsets, blank)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    folded = np.zeros(len(data) + 8, np.uint8)
    folded[: len(data)] = _FOLD[data]
    eight = np.ndarray(len(data) + 1, "<u8", folded, strides=(1,))  # the eight bytes from each place on
    length = ends - starts
    h = length.astype(np.uint64) * _BASE
    todo, done = np.arange(len(starts)), 0
    while len(todo):
        step = (h[todo] ^ (eight[starts[todo] + done] & _LOW[np.minimum(length[todo] - done, 8)])) * _BASE
        h[todo] = step ^ (step >> np.uint64(32))
        done += 8
        todo = todo[(length[todo] > done) & (length[todo] <= _LONG)]
    for k in np.flatnonzero(length > _LONG):
        h[k] = xxhash.xxh64_intdigest(folded[starts[k] : ends[k]])
    return mix(h), rows


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words within a row, and row offsets. A row of fewer words (but some) has one run, the whole."""
    n, length = len(hashes), np.diff(rows)
    count = np.where(length >= width, length - width + 1, np.minimum(length, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    if not n:
        return np.zeros(0, np.uint64), out
    at = np.repeat(rows[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    stop = np.repeat(rows[1:], count)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        place = at + k
        h = np.where(place < stop, h * _BASE + hashes[np.minimum(place, n - 1)], h)
    return mix(h), out
