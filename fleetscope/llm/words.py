"""Words and their 64-bit hashes straight from Arrow string buffers, without a Python object per word.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``) after A-Z were
lower-cased. Texts are worked through in pieces that end between words, so the
working memory does not grow with the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = " \t\n\x0b\x0c\r"
PIECE = 1 << 20
_SEED = 20240229
_BASE = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in WHITE]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _byte_values() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    out = []
    for base in (_BASE, inverse):
        row = np.full(size, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = 8 << 20):
    """Slices of a batch with about ``limit`` bytes in a string column each; a longer text is alone in its slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for first, last in zip(bounds, bounds[1:]):
        if last > first:
            yield batch.slice(first, last - first)


def _pieces(space: np.ndarray, cut: np.ndarray, size: int):
    """Bounds of pieces of about ``PIECE`` bytes that begin and end between words."""
    at = 0
    while at < size:
        end = min(at + PIECE, size)
        while end < size and not (space[end] or space[end - 1] or cut[end]):
            ahead = np.flatnonzero(space[end : end + PIECE] | cut[end : min(end + PIECE, size)])
            end = end + int(ahead[0]) if len(ahead) else min(end + PIECE, size)
        yield at, end
        at = end


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every row) of an Arrow string column."""
    data, offsets = buffers(column)
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    space = _SPACE[data]
    cut = np.zeros(size + 1, bool)
    cut[offsets] = True
    values = _byte_values()
    power, inverse = _powers(min(size, 2 * PIECE))
    found, firsts = [], []
    for at, end in _pieces(space, cut, size):
        word = ~space[at:end]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | cut[at + 1 : end]
        last[:-1] &= ~word[1:] | cut[at + 1 : end]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if end - at > len(power):  # one word as long as a piece
            power, inverse = _powers(end - at)
        total = np.zeros(end - at + 1, np.uint64)
        np.cumsum(values[_LOWER[data[at:end]]] * power[: end - at], out=total[1:])
        found.append(mix((total[ends] - total[begins]) * inverse[begins]))
        firsts.append(begins + at)
    starts = np.concatenate(firsts)
    counts = np.diff(np.searchsorted(starts, offsets))
    return np.concatenate(found), counts


def join_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes; order matters."""
    h = np.full(len(columns[0]), np.uint64(len(columns)), np.uint64)
    for column in columns:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + column)
    return h


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``size`` words, number per row).

    A row with fewer words gives its whole sequence as one; a row without words none.
    """
    ends = np.cumsum(counts)
    full = np.maximum(counts - size + 1, 0)
    inside = np.repeat(ends, counts) - np.arange(len(hashes)) >= size
    begins = np.flatnonzero(inside)
    long = join_hashes([hashes[begins + i] for i in range(size)]) if len(begins) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if not len(short):
        return long, full
    single = np.array(
        [join_hashes([hashes[i : i + 1] for i in range(ends[r] - counts[r], ends[r])])[0] for r in short], np.uint64
    )
    out_counts = full.copy()
    out_counts[short] = 1
    out = np.empty(len(long) + len(single), np.uint64)
    at = np.cumsum(out_counts) - out_counts
    taken = np.zeros(len(out), bool)
    taken[at[short]] = True
    out[taken], out[~taken] = single, long
    return out, out_counts
