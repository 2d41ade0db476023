"""Quality classifier: a factorisation machine for quality and another for toxicity.

Features are the hashed different words of a text, statistics of its structure in bins, and its source and language.
Pairwise interactions have low rank: with S = sum of x_i v_i, they come to half of |S|**2 - sum of |x_i v_i|**2, so a
text is scored in time linear in its features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm import text as T
from siftmark.llm.shared import tuned

BITS, RANK, WORD_VALUE = 18, 8, 0.3
TRAIN_ROWS = 20_000
MOST_SENT = 200_000  # labels that are sent to all tasks; more are joined by a shuffle
EPOCHS, BATCH, RATE, DECAY = 4, 128, 0.1, 1e-6
STEPS = 100  # at least, as a small table has few in EPOCHS
DOUBT = 5.0  # a word of n labelled texts counts n / (n + DOUBT): few texts say little, but not nothing
LEAST_QUALITY, MOST_TOXIC = 0.5, 0.2  # toxic texts are rare, so a fifth is suspicion enough
HEADS = ("quality", "toxic")
_STATISTICS = 10
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower-case or not ASCII, 2 upper-case, 3 digit, 4 space, 5 line break, 6 mark
_KIND[[*range(33, 127)]] = 6
_KIND[[*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = 1
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_KIND[[*b"0123456789"]] = 3
_KIND[[*b" \t"]] = 4
_KIND[[*b"\r\n"]] = 5


def _bucket(kind: int, value: np.ndarray) -> np.ndarray:
    return (T.mix(value.astype(np.uint64) * np.uint64(64) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int32)


def _hash(column: pa.Array) -> np.ndarray:
    """A number for each string; null is one as well."""
    names = column.fill_null("\0null").dictionary_encode()
    own = np.array([int.from_bytes(x.encode(), "little") % ((1 << 61) - 1) + len(x) for x in names.dictionary.to_pylist()], np.uint64)
    return own[names.indices.to_numpy(zero_copy_only=False)]


def _structure(w: T.Words, part: pa.Array) -> np.ndarray:
    """Bins of the statistics, [texts, _STATISTICS]."""
    data, at = T._buffer(part)
    size = np.diff(at)
    kinds = np.bincount(np.repeat(np.arange(len(size)) * 7, size) + _KIND[data], minlength=7 * len(size)).reshape(-1, 7)
    share = kinds / np.maximum(size, 1)[:, None]
    n = np.diff(w.bounds)
    again = np.zeros(len(w.hashes), np.int64)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    again[w.bounds[:-1][n > 0]] = 0
    text = w.text_of()
    repeated = np.bincount(text, again, len(n)) / np.maximum(n, 1)
    letters = np.bincount(text, w.ends - w.starts, len(n)) / np.maximum(n, 1)
    log = lambda x: np.log2(x + 1)
    fine = lambda x: np.ceil(20 * np.sqrt(x))
    return np.stack((log(n), letters, fine(share[:, 2]), fine(share[:, 3]), fine(share[:, 4]), fine(share[:, 5]), fine(share[:, 6]), fine(share[:, 0]), fine(repeated), log(n / (kinds[:, 5] + 1))), 1).astype(np.int64)


def features(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, bucket, value, bounds of each text), chunk by chunk; every text has features."""
    source, lang = _hash(T.column_of(batch, "source")), _hash(T.column_of(batch, "lang"))
    column = T.column_of(batch, "text")
    for first, part in T.chunks(column):
        part = part.fill_null("")
        (w,) = T.words(part)
        k = w.texts
        words = np.unique((w.text_of().astype(np.uint64) << np.uint64(32)) | (w.hashes >> np.uint64(32)))
        own = (words >> np.uint64(32)).astype(np.int64)
        rest = np.empty((k, _STATISTICS + 2), np.int32)
        bins = _structure(w, part)
        for s in range(_STATISTICS):
            rest[:, s] = _bucket(1 + s, bins[:, s])
        rest[:, -2], rest[:, -1] = _bucket(40, source[first : first + k]), _bucket(41, lang[first : first + k])
        bounds = np.append(0, np.cumsum(np.bincount(own, minlength=k) + rest.shape[1]))
        bucket, value = np.empty(bounds[-1], np.int32), np.full(bounds[-1], WORD_VALUE, np.float32)
        at = bounds[:-1, None] + np.arange(rest.shape[1])
        bucket[at], value[at] = rest, 1.0
        bucket[np.arange(len(own)) + rest.shape[1] * (own + 1)] = _bucket(0, words & np.uint64(0xFFFFFFFF))
        yield first, bucket, value, bounds


@dataclass
class Machine:
    """bias [heads]; table [buckets, heads * (1 + RANK)]: weight, then factors, of each head."""

    bias: np.ndarray
    table: np.ndarray

    def logits(self, bucket: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows = self.table[bucket] * value[:, None]
        sums = np.add.reduceat(rows, bounds[:-1]).reshape(len(bounds) - 1, len(self.bias), -1)
        squares = np.add.reduceat(rows * rows, bounds[:-1]).reshape(sums.shape)
        return self.bias + sums[:, :, 0] + 0.5 * (sums[:, :, 1:] ** 2 - squares[:, :, 1:]).sum(2)


def fit(bucket: np.ndarray, value: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 3, weights: np.ndarray | None = None) -> Machine:
    """Adagrad on the logistic loss of all heads at once; labels are [texts, heads], negative where unknown, and weights
    say how many texts each one stands for."""
    heads, width = labels.shape[1], 1 + RANK
    r = np.random.default_rng(seed)
    table = r.normal(0, 0.02, (1 << BITS, heads * width)).astype(np.float32)
    table[:, ::width] = 0
    texts = np.bincount(bucket, minlength=1 << BITS)
    trust = (texts / (texts + DOUBT)).astype(np.float32)
    value = value * trust[bucket]
    known = labels >= 0
    weights = np.ones(len(labels)) if weights is None else weights / weights.mean()
    rate = ((np.where(known, labels, 0) * weights[:, None]).sum(0) + 1) / ((known * weights[:, None]).sum(0) + 2)
    machine = Machine(np.log(rate / (1 - rate)), table)
    seen, seen_bias = np.full_like(table, 1e-3), np.full(heads, 1e-3)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(labels)))
    for epoch in range(epochs):
        order = r.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            speed = RATE * (1 - (epoch + low / len(order)) / epochs)
            pick = order[low : low + BATCH]
            size = np.diff(bounds)[pick]
            take = np.repeat(bounds[pick] - np.cumsum(size) + size, size) + np.arange(size.sum())
            own = np.repeat(np.arange(len(pick)), size)
            b, x = bucket[take], value[take][:, None]
            rows = table[b] * x
            at = np.cumsum(size) - size
            sums = np.add.reduceat(rows, at).reshape(len(pick), heads, width)
            squares = np.add.reduceat(rows * rows, at).reshape(sums.shape)
            logit = machine.bias + sums[:, :, 0] + 0.5 * (sums[:, :, 1:] ** 2 - squares[:, :, 1:]).sum(2)
            error = np.where(known[pick], 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick], 0) * weights[pick][:, None]
            slope = sums.copy()
            slope[:, :, 0] = 1
            g = (slope[own] - rows.reshape(-1, heads, width) * (np.arange(width) > 0)) * (error[own] / len(pick))[:, :, None]
            g = g.reshape(len(b), -1) * x
            by = np.argsort(b, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], b[by][1:] != b[by][:-1])))
            which = b[by][first]
            step = np.add.reduceat(g[by], first) + DECAY * table[which]
            seen[which] += step * step
            table[which] -= (speed * step / np.sqrt(seen[which])).astype(np.float32)
            e = error.mean(0)
            seen_bias += e * e
            machine.bias -= speed * e / np.sqrt(seen_bias)
    table *= trust[:, None]
    return machine


def _columns(docs: DataFrame) -> list[Column]:
    """text, source and lang as strings; a column that docs lacks is null."""
    return [(docs[c].cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("text", "source", "lang")]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine | None:
    """A machine fitted to at most `rows` labels; all labels where there are fewer. Else toxic ones fill up to half of
    them and the others the rest, those of least hash each, weighted by how many they stand for. Labels of other values than
    0 and 1 are unknown. None where no label has a document."""
    tuned(docs.sparkSession)
    flag = lambda c: F.when(labels[c].isin(0, 1), labels[c].cast("int")).otherwise(-1).alias(c)
    own = labels.where(labels["doc_id"].isNotNull()).select(labels["doc_id"].cast("long").alias("doc_id"), *map(flag, HEADS))
    is_toxic = F.col("toxic") == 1
    there = own.agg(F.count("*").alias("n"), F.count(F.when(is_toxic, 1)).alias("toxic")).first()
    others, share = there["n"] - there["toxic"], (1.0, 1.0)
    if there["n"] > rows:
        some = min(there["toxic"], max(rows // 2, rows - others))
        share = there["toxic"] / max(some, 1), others / max(rows - some, 1)
        drawn = [own.where(c).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", *HEADS).limit(k) for c, k in ((is_toxic, some), (~is_toxic, rows - some))]
        own = drawn[0].unionAll(drawn[1])
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_columns(docs)).join(F.broadcast(own) if rows <= MOST_SENT else own, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, bucket, value, bounds in features(batch):
                k = len(bounds) - 1
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (bucket, value)]
                yield pa.RecordBatch.from_arrays([*(T.column_of(batch, c).slice(first, k) for c in ("doc_id", *HEADS)), *lists], ["doc_id", *HEADS, "bucket", "value"])

    got = found.mapInArrow(run, "doc_id long, quality int, toxic int, bucket array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("doc_id", "ascending"), *((c, "ascending") for c in HEADS)]).combine_chunks()
    bounds = np.append(0, np.cumsum(pc.list_value_length(got["bucket"]).to_numpy()))
    bucket, value = (pc.list_flatten(got[c]).to_numpy() for c in ("bucket", "value"))
    flags = np.stack([got[c].to_numpy() for c in HEADS], 1)
    return fit(bucket, value, bounds, flags, weights=np.where(flags[:, 1] == 1, *share))


def classify(docs: DataFrame, machine: Machine | None, least: float = LEAST_QUALITY, most: float = MOST_TOXIC) -> DataFrame:
    """(doc_id, quality, toxic, keep) for every row of docs: probabilities of the two labels, and whether quality is
    `least` or more and toxicity under `most`.

    Null and empty texts have quality 0.0 and toxicity 0.0 and aren't kept; without a machine the probabilities of
    others are null and they are kept. Rows with a null doc_id and repeated rows each give a row. Where source
    or lang is null or missing, that is a value of its own. A very long text is scored as a whole. Other columns are
    not read. An empty table gives none.
    """
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            ids = T.column_of(batch, "doc_id")
            for first, bucket, value, bounds in features(batch):
                k = len(bounds) - 1
                blank = pc.equal(pc.binary_length(T.column_of(batch, "text").slice(first, k).fill_null("")), 0).to_numpy(zero_copy_only=False)
                p = np.full((k, 2), np.nan) if machine is None else 1 / (1 + np.exp(-np.clip(machine.logits(bucket, value, bounds), -30, 30)))
                p[blank] = 0
                keep = ~blank & ((machine is None) | ((p[:, 0] >= least) & (p[:, 1] < most)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, k), *(pa.array(p[:, h], mask=np.isnan(p[:, h])) for h in range(2)), pa.array(keep)], ["doc_id", "quality", "toxic", "keep"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_columns(docs)).mapInArrow(run, "doc_id long, quality double, toxic double, keep boolean")
