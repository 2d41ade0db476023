"""Document fingerprints by winnowing.

A text is lower-cased and reduced to its word characters. Every k of them in a row have a Karp-Rabin hash; of
every `window` hashes in a row the least is kept, the rightmost where several are least. Two texts that share
k + window - 1 normalised characters therefore share a fingerprint, and the positions say where. A fingerprint has 62 bits:
what is kept has a hash by a second modulus as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftmark.llm import text as T
from siftmark.llm.shared import tuned

K, WINDOW = 32, 64
PRIMES, BASE = ((1 << 31) - 1, (1 << 31) - 19), 1_000_003
_LOW = np.int64(0xFFFFFFFF)
_KEEP = np.zeros(128, bool)
_KEEP[[*b"0123456789abcdefghijklmnopqrstuvwxyz_"]] = True


def rolling(points: np.ndarray, k: int, prime: int) -> np.ndarray:
    """Sum of points[i + j] * BASE**(k - 1 - j) modulo prime for every i, by doubling."""
    have, out = 0, None
    power, size = points.astype(np.int64) % prime, 1
    while True:
        if k & size:
            if out is None:
                out, have = power, size
            else:  # the block of `size` goes before what there is
                n = max(0, len(points) - have - size + 1)
                out = (power[:n] * pow(BASE, have, prime) + out[size : size + n]) % prime
                have += size
        if have == k:
            return out
        n = max(0, len(points) - 2 * size + 1)
        power = (power[:n] * pow(BASE, size, prime) + power[size : size + n]) % prime
        size *= 2


def second(points: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash by the second modulus of the k-grams that begin at `at`."""
    out = np.zeros(len(at), np.int64)
    for j in range(k):
        out = (out * BASE + points[at + j]) % PRIMES[1]
    return out


def winnow(points: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions in the normalised stream, ascending, and their fingerprints; bounds delimit the texts in it."""
    hashes = rolling(points, k, PRIMES[0])
    keys = (hashes << np.int64(32)) | (_LOW - np.arange(len(hashes)))
    counts = np.diff(bounds) - (k - 1)
    chosen = []
    if len(keys) >= window:
        least = T.sliding_min(keys, window)
        chosen.append(least[T.within(bounds, window + k - 1, len(points))])
    short = np.flatnonzero((counts > 0) & (counts < window))
    if len(short):
        cuts = np.stack((bounds[short], bounds[short] + counts[short]), 1).ravel()
        if cuts[-1] == len(keys):
            cuts = cuts[:-1]
        chosen.append(np.minimum.reduceat(keys, cuts)[::2])
    at = T.distinct(_LOW - (np.concatenate(chosen) & _LOW)) if chosen else np.zeros(0, np.int64)
    return at, (hashes[at] << np.int64(31)) | second(points.astype(np.int64), at, k)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, pos, fingerprint), a row for each chosen k-gram; pos is its first character in the lower-cased text.

    A text with fewer than `window` k-grams is one window; a null or empty text, or one of under k word
    characters, gives no row; a very long one is fingerprinted as a whole. Rows with a null doc_id, and repeated rows, are each fingerprinted. Columns other
    than doc_id and text are not read. An empty table gives an empty result.
    """
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = T.column_of(batch, "doc_id")
            for first, points, bounds in T.codepoints(T.column_of(batch, "text")):
                keep = np.ones(len(points), bool)
                ascii_ = points < 128
                keep[ascii_] = _KEEP[points[ascii_]]
                where = np.flatnonzero(keep)
                inner = np.searchsorted(where, bounds)
                at, hashes = winnow(points[where], inner, k, window)
                doc = np.searchsorted(inner, at, "right") - 1
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + doc)), pa.array((where[at] - bounds[doc]).astype(np.int32)), pa.array(hashes)], ["doc_id", "pos", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, pos int, fingerprint long")


def sql(k: int = K, window: int = WINDOW) -> str:
    """The same rows by DuckDB, with lists for each document and no sort; k and window are powers of two here."""
    pair = lambda x, n: f"list_zip({x}[1:greatest(0, len({x}) - {n})], {x}[{n} + 1:])"
    steps, last = [], "h1"
    for size in (1 << i for i in range(k.bit_length() - 1)):
        each = (f"list_transform({pair(x, size)}, lambda y: (y[1] * {pow(BASE, size, p)} + y[2]) % {p}) AS {x}" for x, p in zip("ab", PRIMES))
        steps.append(f"h{2 * size} AS (SELECT doc_id, pos, {', '.join(each)} FROM {last})")
        last = f"h{2 * size}"
    steps.append(f"m1 AS (SELECT doc_id, pos, a, b, list_transform(list_zip(a, range(len(a))), lambda y: y[1] * 4294967296 + (4294967295 - y[2])) AS x FROM {last} WHERE len(a) > 0)")
    last = "m1"
    for size in (1 << i for i in range(window.bit_length() - 1)):
        least = f"CASE WHEN len(a) < {window} THEN [list_min(x)] ELSE list_transform({pair('x', size)}, lambda y: least(y[1], y[2])) END AS x"
        steps.append(f"m{2 * size} AS (SELECT doc_id, pos, a, b, {least} FROM {last})")
        last = f"m{2 * size}"
    return f"""
WITH d AS (SELECT doc_id, string_split(lower(text), '') AS cs FROM documents),
e AS (SELECT doc_id, list_filter(list_zip(cs, range(len(cs))), lambda y: regexp_matches(y[1], '{T.WORD}')) AS z FROM d),
h1 AS (SELECT doc_id, list_transform(z, lambda y: y[2]) AS pos, list_transform(z, lambda y: unicode(y[1])::BIGINT) AS a, list_transform(z, lambda y: unicode(y[1])::BIGINT) AS b FROM e),
{", ".join(steps)},
u AS (SELECT doc_id, pos, b, unnest(list_distinct(x)) AS x FROM {last}),
j AS (SELECT doc_id, pos, b, x, 4294967295 - x % 4294967296 + 1 AS j FROM u)
SELECT doc_id, pos[j]::INT AS pos, x // 4294967296 * 2147483648 + b[j] AS fingerprint FROM j"""
