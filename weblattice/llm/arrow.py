"""Batches of texts in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches of about ``size`` characters, with the texts of one column; a longer text is a slice of its own."""
    for batch in batches:
        start, held, total = 0, [], 0
        for k, value in enumerate(batch.column(column)):
            held.append(value.as_py())
            total += len(held[-1] or "")
            if total >= size or k + 1 == batch.num_rows:
                yield batch.slice(start, k + 1 - start), held
                start, held, total = k + 1, [], 0


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one row, and where each text ends."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.default_rng(20240601)
#: A random 64-bit number for each byte, and an odd multiplier for places.
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    """The first powers of the place multiplier modulo 2**64."""
    global _powers
    if len(_powers) < count:
        out, done = np.ones(1 << (count - 1).bit_length(), np.uint64), 1
        while done < len(out):
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(pow(_PLACE, done, 1 << 64))
            done += more
        _powers = out
    return _powers


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def utf8(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line feed, and the ends of the texts (after their line feed)."""
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))


def runs(data: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not separators; the last byte must be one."""
    gap = apart[data]
    edges = np.diff(np.concatenate(([True], gap)).view(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, of all of them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    # bytes of the runs alone, and the place of each in its run
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = _BYTE_VALUES[data[place + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[place]
    return mix64(np.add.reduceat(values, first) + sizes.astype(np.uint64))
