"""Words of Arrow string columns as numpy arrays.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased
text. It is known by a 64-bit hash of its bytes. WORD is the same rule as a regular expression for RE2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
CHUNK = 500_000  # bytes of text taken at once; a longer text is a chunk of its own

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz_", *range(128, 256)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, a bijection."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.full(1 << max(n, 1 << 16).bit_length(), base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a chunk of texts. bounds[i]:bounds[i+1] are those of text i; at[i] is where its bytes start in data."""

    first: int
    data: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))


def chunks(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about CHUNK bytes with the index of their first text."""
    size = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    total, first = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > CHUNK:
            yield first, column[first:i]
            total, first = 0, i
        total += n + 1
    if first < len(column):
        yield first, column[first:]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string array."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[Words]:
    """The words of every text, chunk by chunk; a null text has none. With lower=False the text must be lower case."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first, part in chunks(column):
        part = part.fill_null("")
        part = pc.binary_join_element_wise(pc.utf8_lower(part) if lower else part, "", "\n")
        data, at = _buffer(part)
        yield _words(first, data, at)


def words_of_all(column: pa.Array) -> Words:
    """The words of all texts as one chunk."""
    data, at = _buffer(pc.binary_join_element_wise(pc.utf8_lower(column.fill_null("")), pa.scalar("", column.type), pa.scalar("\n", column.type)))
    return _words(0, data, at)


def codepoints(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, code points of the lower-cased texts, bounds of each text), chunk by chunk."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first, part in chunks(column):
        part = pc.utf8_lower(part.fill_null(""))
        data, _ = _buffer(part)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        yield first, points, np.concatenate(([0], np.cumsum(pc.utf8_length(part).to_numpy(zero_copy_only=False).astype(np.int64))))


def _words(first: int, data: np.ndarray, at: np.ndarray) -> Words:
    word = _IS_WORD[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(first, data, at, hashes, starts, ends, np.searchsorted(starts, at))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + m]
    return mix(out)


def within(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 windows of n words lie in one text."""
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        cut = bounds[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def _heads(x: np.ndarray) -> np.ndarray:
    """Where other values begin in ascending ones."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def distinct(x: np.ndarray) -> np.ndarray:
    """As np.unique; a sort takes a tenth of the time that its hash table takes on millions of numbers."""
    x = np.sort(x)
    return x[_heads(x)]


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and how often each occurs."""
    x = np.sort(x)
    at = _heads(x)
    return x[at], np.diff(np.append(at, len(x)))


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and the place of each element's value among them."""
    order = np.argsort(x)
    x = x[order]
    at = _heads(x)
    place = np.empty(len(x), np.int32)
    place[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(x))))
    return x[at], place


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w keys in a row, by doubling."""
    out, have = keys, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
