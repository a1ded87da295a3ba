"""Vectorised word and shingle hashing shared by the text operators.

Texts arrive as Arrow batches and are worked on in slices of a bounded number
of bytes, so that a task's memory depends on the slice (and on its longest
single text), never on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _byte_codes() -> np.ndarray:
    """A random 64-bit code per byte; A-Z share the codes of a-z."""
    codes = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


_powers: dict[int, np.ndarray] = {}
_HASH_BYTES = 1 << 16


def power_table(base: int, n: int) -> np.ndarray:
    """The first n powers of base, 2 * _HASH_BYTES at most."""
    if base not in _powers:
        steps = np.full(2 * _HASH_BYTES, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray, base: int) -> np.ndarray:
    """Hashes of ascending, disjoint byte spans, from running sums over blocks of about _HASH_BYTES.

    A span's hash is the sum of its bytes' codes times powers of ``base``, so it
    doesn't depend on where it stands. A span longer than a block is summed block by block.
    """
    inverse = pow(base, -1, 1 << 64)
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, first + _HASH_BYTES, side="right")))
        n = int(ends[to - 1]) - first
        if n > _HASH_BYTES:
            total = 0
            for lo in range(0, n, _HASH_BYTES):
                block = codes[buf[first + lo : first + min(lo + _HASH_BYTES, n)]]
                own = int((block * power_table(base, len(block))).sum(dtype=np.uint64))
                total = (total + own * pow(base, lo, 1 << 64)) & ((1 << 64) - 1)
            out[at] = np.uint64(total)
            at = to
            continue
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[buf[first : first + n]] * power_table(base, n), out=sums[1:])
        lo, hi = starts[at:to] - first, ends[at:to] - first
        out[at:to] = (sums[hi] - sums[lo]) * power_table(inverse, n + 1)[lo]
        at = to
    return out


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (bijective for a fixed salt)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: byte spans in ``data``, hashes, and per-text offsets."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray  # text i has words offsets[i]:offsets[i+1]
    text_starts: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, hashed with A-Z in lower case."""
    data = b" ".join(texts) + b" "
    buf = np.frombuffer(data, dtype=np.uint8)
    blank = _BLANK[buf]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    hashes = mix(span_hashes(buf, starts, ends, _byte_codes(), _BASE))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    return Words(data, starts, ends, hashes, np.searchsorted(starts, text_starts), text_starts)


def shingle_hashes(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and per-text offsets into them.

    A text of 1 to ``size`` - 1 words has one shingle, its whole sequence; a
    text without words has none.
    """
    counts = np.diff(words.offsets)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    total = len(words.hashes)
    rolled = np.zeros(total, dtype=np.uint64)
    for j in range(size):
        part = mix(words.hashes[j:], salt=j + 1)
        rolled[: len(part)] += part
    first = np.repeat(words.offsets[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    out = mix(rolled[first]) if total else rolled[first]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        lo, hi = words.offsets[i], words.offsets[i + 1]
        own = sum((mix(words.hashes[lo + j : lo + j + 1], salt=j + 1) for j in range(hi - lo)), np.zeros(1, np.uint64))
        out[offsets[i]] = mix(own, salt=1000 + int(hi - lo))[0]
    return out, offsets


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x if x is not None else b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each slice has about ``limit`` bytes of ``column`` at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, without a copy, and len + 1 offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit codes as the long type that Spark has."""
    return x.view(np.int64)
