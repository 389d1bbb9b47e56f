"""Files of numpy arrays in the shared scratch folder, memory-mapped by the tasks that read them, and sorted hash tables in such files."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import urlsplit

import numpy as np

_ALIGN = 64


def _bytes_of(arrays: list[np.ndarray]) -> bytes:
    head, at, parts = [], 0, []
    for a in arrays:
        gap = -at % _ALIGN
        parts += [b"\0" * gap, a.tobytes()]
        head.append((a.dtype.str, len(a), at + gap))
        at += gap + a.nbytes
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % _ALIGN)
    return b"".join([len(text).to_bytes(8, "little"), text, *parts])


def save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Writes folder/name, all or nothing: a task that runs again leaves the same file."""
    parts, data = urlsplit(folder), _bytes_of(arrays)
    if parts.scheme in ("", "file"):
        os.makedirs(parts.path, exist_ok=True)
        hidden = f"{parts.path}/.{name}-{uuid.uuid4().hex}"
        with open(hidden, "wb") as out:
            out.write(data)
        os.replace(hidden, f"{parts.path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    hidden = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(data)
    store.move(hidden, f"{path}/{name}")


def load(folder: str, name: str) -> list[np.ndarray]:
    """Maps folder/name; what cannot be mapped is copied to an unlinked temporary file first. FileNotFoundError where it is missing."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return _views(np.memmap(f"{parts.path}/{name}", np.uint8, "r"))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(f"{path}/{name}") as source:
        while chunk := source.read(1 << 24):
            copy.write(chunk)
        copy.flush()
        return _views(np.memmap(copy.name, np.uint8, "r"))


def _views(data: np.ndarray) -> list[np.ndarray]:
    n = 8 + int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8:n].tobytes())
    return [data[n + at : n + at + size * np.dtype(kind).itemsize].view(kind) for kind, size, at in head]


# --- sorted hash tables ----------------------------------------------------------------

#: Keys of a bucket on average, at least half of it.
BUCKET = 8


def key_arrays(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit keys as two arrays: where each bucket of leading bits begins, and 32 more bits of each key.

    A key that the table lacks is taken for one that it has with a chance of about BUCKET / 2^32.
    """
    bits = min(32, max(0, (len(keys) // BUCKET).bit_length()))
    bucket = _bucket(keys, bits)
    first = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    return [first.astype(np.uint32 if len(keys) < 1 << 32 else np.uint64), _rest(keys, bits)]


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _rest(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def slots(first: np.ndarray, rest: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, whether it is the key's) of each key: a binary search in its bucket."""
    if not len(rest):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    bits = (len(first) - 1).bit_length() - 1
    bucket, want = _bucket(keys, bits), _rest(keys, bits)
    low, high = first[bucket].astype(np.int64), first[bucket + 1].astype(np.int64)
    end, last = high, len(rest) - 1
    for _ in range(int((high - low).max()).bit_length() if len(keys) else 0):
        middle = (low + high) >> 1
        below = (low < high) & (rest[np.minimum(middle, last)] < want)
        low = np.where(below, middle + 1, low)
        high = np.where(below, high, np.minimum(middle, high))
    at = np.minimum(low, last)
    return at, (low < end) & (rest[at] == want)


def count_arrays(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, and the slots and values of those of 255 and more."""
    many = np.flatnonzero(counts >= 255)
    return [np.minimum(counts, 255).astype(np.uint8), many.astype(np.uint32 if len(counts) < 1 << 32 else np.uint64), counts[many].astype(np.uint64)]


def counts_at(arrays: list[np.ndarray], slot: np.ndarray) -> np.ndarray:
    low, many, value = arrays
    out = low[slot].astype(np.uint64)
    large = np.flatnonzero(out == 255)
    out[large] = value[np.searchsorted(many, slot[large])]
    return out
