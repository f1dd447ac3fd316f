"""NumPy kernels over Arrow text columns, shared by the text operators.

Everything works on slices of a few MB, so a Python worker's memory stays
bounded whatever the length of a batch or the skew of text sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_POW: list[np.ndarray] = []
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (95, 96)):
    _WORD[_a:_b] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; keeps the input."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        m = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            out = []
            for base in (_ODD, _INV):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                out.append(np.cumprod(p))
        _POW[:] = out
    return _POW[0][:n], _POW[1][:n]


def _offsets(arr: pa.Array) -> np.ndarray:
    """Where each row of a text column begins in its data, of either width of offsets."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    return np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.get_field_index(column))
        off = _offsets(arr)
        at = 0
        while at < len(arr):
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets of the rows in them."""
    off = _offsets(arr)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every longest run of ASCII letters, digits and ``_``, case folded."""
    is_word = _WORD[data]
    if not is_word.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    before = np.concatenate(([False], is_word[:-1]))
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.concatenate((is_word[1:], [False]))
    last = off[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    p, inv = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[_FOLD[data]] * p[:-1], out=c[1:])
    h = mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(off, start, "right") - 1


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words of each row, ordered by row, then hash."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = mix(s + h[i : i + n]) + U(i + 1)
    ok = row[:n] == row[k - 1 :]
    s, r = s[ok], row[:n][ok]
    o = np.lexsort((s, r))
    s, r = s[o], r[o]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    return s[new], r[new]


def starts_of(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and count of each of the n rows in an array sorted by row."""
    count = np.bincount(row, minlength=n)
    return np.concatenate(([0], np.cumsum(count)[:-1])), count


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
