"""Vectorised hashing of whole Arrow batches of text: no Python loop over characters or words.

A batch's texts are one byte array. Hashes are pairs of polynomials modulo the prime 2^31 - 1, with random bases and random byte values, taken from
prefix sums, so that the hash of any range of bytes costs two subtractions and two multiplications. (Modulo a power of two some strings would
collide for every base.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME = (1 << 31) - 1
_rng = np.random.default_rng(20240611)
BYTE_VALUES = _rng.integers(1, PRIME, (2, 256)).astype(np.uint32)
BASES = [int(x) for x in _rng.integers(1 << 16, PRIME, 2)]
STEP = np.uint64(0x9E3779B97F4A7C15)
_M, _SHIFT = np.uint64(PRIME), np.uint64(31)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 offsets of the texts in them. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    array = texts.cast(pa.large_string()).fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about most_bytes of text; a single longer text is a part of its own."""
    texts = batch.column(batch.schema.get_field_index(column))
    lengths = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.float64))
    start, size = 0, 0.0
    for i, n in enumerate(lengths):
        if size and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0.0
        size += n
    if start < len(lengths):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a worker keeps nothing of the batch for later


def _fold(x: np.ndarray, high: np.ndarray) -> None:
    """Make each number below 2^64 one below 2^34 or so, equal modulo the prime, in place."""
    np.right_shift(x, _SHIFT, out=high)
    np.bitwise_and(x, _M, out=x)
    np.add(x, high, out=x)


def _reduced(x: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
    """The remainder modulo the prime, in place."""
    high = np.empty_like(x) if high is None else high
    _fold(x, high)
    _fold(x, high)
    np.add(x, np.uint64(1), out=high)  # what is left to subtract is the prime once, or nothing
    np.right_shift(high, _SHIFT, out=high)
    np.add(x, high, out=x)
    return np.bitwise_and(x, _M, out=x)


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^i modulo the prime, for i below n."""
    out = np.ones(n, np.uint32)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = _reduced(out[:more].astype(np.uint64) * np.uint64(pow(base, done, PRIME)))
        done += more
    return out


class Powers:
    """Powers of the bases and of their inverses below a size that grows as needed."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint32)] * 2
        self.down = [np.ones(1, np.uint32)] * 2

    def at_least(self, n: int) -> None:
        if len(self.up[0]) < n:
            self.up = [_powers_of(b, n) for b in BASES]
            self.down = [_powers_of(pow(b, -1, PRIME), n) for b in BASES]


_powers = Powers()


BLOCK = 1 << 15  # numbers worked on at a time, so that they stay in the processor's cache


class RangeHash:
    """64-bit hashes of byte ranges [start, end) of one array, below 4 GB."""

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw)
        _powers.at_least(n + 1)
        self.sums = np.zeros((2, n + 1), np.uint64)
        x, high = np.empty((2, min(n, BLOCK)), np.uint64)
        for values, up, sums in zip(BYTE_VALUES.astype(np.uint64), _powers.up, self.sums):
            for a in range(0, n, BLOCK):
                b = min(a + BLOCK, n)
                value, rest = x[: b - a], high[: b - a]
                np.take(values, raw[a:b], out=value, mode="clip")
                np.multiply(value, up[a:b], out=value)
                _fold(value, rest)
                value[0] += sums[a]
                np.cumsum(value, out=sums[a + 1 : b + 1])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        x, high = np.empty((2, min(len(out), BLOCK)), np.uint64)
        for a in range(0, len(out), BLOCK):
            first, last = start[a : a + BLOCK], end[a : a + BLOCK]
            value, rest = x[: len(first)], high[: len(first)]
            for i, (sums, down) in enumerate(zip(self.sums, _powers.down)):
                np.subtract(sums[last], sums[first], out=value)
                _fold(value, rest)
                _fold(value, rest)
                np.multiply(value, down[first], out=value)
                _fold(value, rest)
                _reduced(value, rest)
                if i:
                    value |= out[a : a + len(first)]
                else:
                    np.left_shift(value, _SHIFT, out=out[a : a + len(first)])
            out[a : a + len(first)] = mix(value)
        return out


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A cheap hash of the ``size`` bytes from each place on (8 to 16), for choosing among places: n - size + 1 values."""
    n = len(raw) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return mix(words[:n] * STEP + words[size - 8 : size - 8 + n])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of non-space bytes; runs never cross texts."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~SPACE[raw]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True  # a text's first byte
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's word shingles after lower-casing A-Z, and the n + 1 offsets of the texts in them. A text with
    fewer words than size has one shingle, its whole sequence; without words, none. Repeats are kept."""
    lowered = LOWER[raw]
    start, end, text = words(raw, offsets)
    hashes = RangeHash(lowered)(start, end)
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    n_out = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(n_out)])
    owner = np.repeat(np.arange(len(count)), n_out)
    at = first[owner] + np.arange(out[-1]) - out[owner]
    span = np.minimum(count, size)[owner]
    value = np.zeros(out[-1], np.uint64)
    for k in range(size):
        inside = span > k
        position = np.minimum(at + k, max(len(hashes) - 1, 0))
        if len(hashes):
            value = np.where(inside, mix(value * STEP + hashes[position] + np.uint64(k + 1)), value)
    return value, out
