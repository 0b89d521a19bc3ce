"""Vectorised text kernels over Arrow buffers: word spans and 64-bit hashes without Python strings.

A batch of texts is one byte buffer with document offsets. Words are maximal runs of non-separator
bytes, never across documents. A word's hash mixes its length and then its bytes, eight at a time,
each step a bijection of the state, so words of up to eight bytes and one length never collide and
others only by chance; words beyond LONG bytes are hashed whole by XXH3. Equal words hash alike
in every batch and process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_PHI = U64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: Words of more bytes are hashed by XXH3.
LONG = 512
#: Bytes handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 19

_rng = np.random.default_rng(20240229)
SHINGLE_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first 0 to 8 bytes of a little-endian block.
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)

#: Separators of words ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=kind, count=len(column) + 1, offset=column.offset * width).astype(np.int64)
    if data is None or data.size == 0:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) pieces of at most ``size`` bytes, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        part = offsets[row : end + 1]
        yield row, end, data[part[0] : part[-1]], part - part[0]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row pointers): words ``pointers[r]`` to ``pointers[r + 1]`` are row r's."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] = word[first]
    end[last] = word[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` maps bytes first, by default A-Z to a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data if fold is None else fold[data]
    blocks = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    sizes = ends - starts
    out = mix(mix(sizes.astype(U64) * _PHI + _PHI) ^ (blocks[starts] & _FIRST[np.minimum(sizes, 8)]))
    more, done = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(more):
        left = sizes[more] - done
        out[more] = mix((out[more] + _PHI) ^ (blocks[starts[more] + done] & _FIRST[np.minimum(left, 8)]))
        more, done = more[left > 8], done + 8
    for w in np.flatnonzero(sizes > LONG):
        out[w] = xxhash.xxh3_64_intdigest(padded[starts[w] : ends[w]].tobytes())
    return out


def windows(hashes: np.ndarray, pointers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row pointers) of each row's runs of ``width`` words; a shorter row's words are one run."""
    n = len(hashes)
    counts = np.diff(pointers)
    long = np.maximum(counts - width + 1, 0)
    out_counts = np.where(counts >= width, long, (counts > 0).astype(np.int64))
    out_pointers = np.concatenate([[0], np.cumsum(out_counts)])
    if not n:
        return np.zeros(0, np.uint64), out_pointers
    salt = lambda w: U64((w * 0xD6E8FEB86659FD93) & _MASK)
    rows = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(int(out_pointers[-1]), np.uint64)
    if n >= width:
        total = hashes[: n - width + 1] * SHINGLE_FACTORS[0]
        for j in range(1, width):
            total += hashes[j : n - width + 1 + j] * SHINGLE_FACTORS[j]
        inside = rows[: n - width + 1] == rows[width - 1 :]
        out[np.repeat(counts >= width, out_counts)] = mix(total[inside] + salt(width))
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[pointers[r] : pointers[r + 1]]
        out[out_pointers[r]] = mix((own * SHINGLE_FACTORS[: len(own)]).sum(dtype=np.uint64, keepdims=True) + salt(len(own)))[0]
    return out, out_pointers
