"""Numpy views of Arrow text columns: byte hashes, words, shingles, packed groups.

Everything here works on one slice of an Arrow batch. Slices hold at most
``SLICE_BYTES`` of text (or one longer text), which bounds the memory of a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
# Odd multipliers of the hashes below; any would do, all tasks must use the same.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def byte_codes(fold: bool = False) -> np.ndarray:
    """A 64-bit code for each byte; with ``fold`` A-Z have the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Prefix polynomial hashes modulo 2^64; ``of(start, end)`` hashes byte ranges."""

    def __init__(self, data: np.ndarray, fold: bool = False, tables: dict | None = None):
        n = len(data)
        tables = {} if tables is None else tables
        if len(tables.get("up", ())) < n + 1:
            size = max(n, SLICE_BYTES)
            tables["up"], tables["down"] = powers(size, BASE), powers(size, BASE_INVERSE)
        self.down = tables["down"]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_codes(fold)[data] * tables["up"][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


# Byte ranges hashed in one step, for memory.
RANGES_AT_ONCE = 1 << 17
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; with ``fold`` A-Z count as a-z.

    A range is read as numbers of eight bytes. Each is mixed with its place and the
    length, the sum is mixed again: no polynomial, so strings that one cancels
    modulo 2^64 (Thue-Morse and its kin) have hashes of their own.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if fold else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), RANGES_AT_ONCE):
        some = slice(k, k + RANGES_AT_ONCE)
        out[some] = _mixed_ranges(eight, starts[some], (ends[some] - starts[some]).astype(np.int64))
    return out


def _mixed_ranges(eight: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    count = np.maximum((lengths + 7) >> 3, 1)
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    left = np.repeat(lengths, count) - 8 * place
    chunk = eight[np.minimum(np.repeat(starts, count) + 8 * place, len(eight) - 1)]
    keep = np.clip(left, 0, 8).astype(np.uint64) * np.uint64(8)
    short = keep < 64
    chunk[short] &= (np.uint64(1) << keep[short]) - np.uint64(1)
    seed = mix(np.repeat(lengths, count).astype(np.uint64) * np.uint64(BASE) + place.astype(np.uint64) * np.uint64(MIX_B))
    return mix(np.add.reduceat(mix(chunk ^ seed) * np.uint64(BASE), first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of at most ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        _, at = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run without separators; runs end with their text."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``size`` words; a shorter text has one over all its words."""
    out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    count = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    if len(hashes) >= size:
        keep = np.flatnonzero(text[size - 1 :] == text[: len(text) - size + 1])
        out.append(_folded(hashes, keep, np.full(len(keep), size)))
        of.append(text[keep])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        out.append(_folded(hashes, np.searchsorted(text, short), count[short]))
        of.append(short)
    return np.concatenate(out), np.concatenate(of)


def _folded(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = mix(length.astype(np.uint64))
    for k in range(int(length.max(initial=0))):
        more = length > k
        total[more] = mix(total[more] + hashes[start[more] + k])
    return total


def pack(values: np.ndarray, n_bytes: int) -> np.ndarray:
    """The low ``n_bytes`` of each unsigned value, as a byte table with a row per value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes]


def unpack(raw: bytes, n_bytes: int) -> np.ndarray:
    table = np.zeros((len(raw) // n_bytes, 8), np.uint8)
    table[:, :n_bytes] = np.frombuffer(raw, np.uint8).reshape(-1, n_bytes)
    return table.view("<u8").ravel()


def content_number(*parts: bytes) -> int:
    """A non-negative 63-bit number that depends on the bytes only."""
    digest = hashlib.blake2b(digest_size=8)
    for part in parts:
        digest.update(part)
    return int.from_bytes(digest.digest(), "big") >> 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each piece, one piece after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[start] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = keys[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def distinct_within(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, value) without repeats, sorted by both."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return text[fresh], values[fresh]


def sums_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2^64 of the values of each index; ``index`` is sorted."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    edges = np.searchsorted(index, np.arange(n + 1))
    return total[edges[1:]] - total[edges[:-1]]
