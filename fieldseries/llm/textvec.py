"""Vectorised helpers on Arrow string columns: slices of bounded bytes, words and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task turns into number arrays at once; a longer document is a slice of its own.
SLICE_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text column of each slice has about ``most`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = text_bytes(batch.column(column))[1][1:]
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else ends[0] * 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets into them; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        return text_bytes(column.cast(pa.large_string()))
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.cumprod(grown, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * BASE**i`` modulo 2**64, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values))[0], out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) that do not depend on where a span stands."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the rows' offsets into them.

    Words are maximal runs of bytes other than space and 0x09 to 0x0D; no word crosses a row.
    """
    raw, bounds = text_bytes(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[bounds] = True
    start = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    end = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    sums = span_sums(_LOWER[raw].astype(np.uint64) + np.uint64(1))
    return span_hash(sums, start, end), np.searchsorted(start, bounds)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words of each row, sorted in each row, and the rows' offsets.

    A row with fewer words has one shingle, all its words; a row without words has none.
    """
    full = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        full = full * _BASE + words[k : k + len(full)]
    full = mix(full + np.uint64(size))
    parts, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            one = np.sort(full[a : b - size + 1])
            one = one[np.concatenate(([True], one[1:] != one[:-1]))]
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * _BASE + w
            one = mix(h + np.uint64(b - a))
        else:
            one = full[:0]
        parts.append(one)
        sizes.append(len(one))
    return np.concatenate(parts) if parts else full[:0], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
