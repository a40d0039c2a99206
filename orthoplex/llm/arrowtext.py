"""Vectorised handling of Arrow string columns.

The helpers work on the UTF-8 buffer that Arrow already holds, so texts are
never decoded one by one.  Every function treats null as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled at once; bounds the size of numpy temporaries.
CHUNK_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def drop_clashing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without the columns that an operator is about to add (names compare without case)."""
    taken = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in taken]
    return df.select(*[df[f"`{c}`"] for c in keep]) if len(keep) < len(df.columns) else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the offsets of each text in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n, first = len(column), column.offset
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = (
        np.frombuffer(offs, kind, n + 1, first * np.dtype(kind).itemsize).astype(np.int64)
        if offs is not None and offs.size
        else np.zeros(n + 1, np.int64)
    )
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def table(members: Iterable[int]) -> np.ndarray:
    """A boolean per byte value."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but space and tab to carriage return, as in [^\x20\x09-\x0D].
NOT_SPACE = table(set(range(256)) - {32, 9, 10, 11, 12, 13})


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes, and the first word of each text (one entry more than texts)."""
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    begins = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return begins, ends, np.searchsorted(begins, offsets)


class Powers:
    """Powers of an odd constant and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = _MULT) -> None:
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, CHUNK_BYTES * 2)
            self.up, self.down = (self._series(b, self.size) for b in (self.base, self.inverse))
        return self.up, self.down

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out


_POWERS = Powers()
_VALUES = np.random.default_rng(20240607).integers(1, _MASK, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal spans hash alike wherever they stand."""
    if not len(begins):
        return np.empty(0, np.uint64)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


_MASK_OF = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_keys(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first sixteen bytes of each word as two numbers; longer words have all ones and a number of their own."""
    size = ends - begins
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    eight = np.ndarray(len(data) + 16, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    a = eight[begins] & _MASK_OF[np.minimum(size, 8)]
    b = eight[np.minimum(begins + 8, len(data))] & _MASK_OF[np.clip(size - 8, 0, 8)]
    seen: dict[bytes, int] = {}
    for k in np.flatnonzero(size > 16).tolist():
        a[k], b[k] = np.uint64(_MASK), seen.setdefault(data[begins[k] : ends[k]].tobytes(), len(seen))
    return a, b


def word_ids(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each different word, from its keys and its size (a word may end in zero bytes); no hash decides."""
    order = np.lexsort((np.minimum(size, 17), b, a))
    fresh = np.zeros(len(order), bool)
    x, y, z = a[order], b[order], np.minimum(size, 17)[order]
    fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def triples(ids: np.ndarray) -> np.ndarray:
    """A number for each run of three ids, equal where all three are."""
    if len(ids) < 3:
        return np.empty(0, np.int64)
    n = int(ids.max()) + 1
    pairs = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    return pairs * n + ids[2:]


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes (runs may cross texts; the caller masks those)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= np.uint64(_MULT)
        out += hashes[j : j + m]
    return mix(out)
