"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm import text as T
from siftmark.llm.shared import fresh, mapped, quoted, tuned

ORDERS, BITS, ALPHA = (1, 2, 3), 16, 0.5
TRAIN_ROWS = 20_000
LEAST_CONFIDENCE = 0.5
TOGETHER, MOST_KEPT = 64, 8  # languages of a table, and tables that a task keeps


def buckets(points: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each code point; 1 << BITS where it would leave its text."""
    n = len(points)
    out = np.full(n, 1 << BITS, np.int32)
    m = max(0, n - order + 1)
    h = np.full(m, order, np.uint32)
    for k in range(order):
        h *= np.uint32(0x01000193)
        h ^= points[k : k + m]
        h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    out[:m] = h >> np.uint32(32 - BITS)
    for k in range(1, order):  # starts too near the end of a text
        at = bounds[1:] - k
        out[at[at >= bounds[:-1]]] = 1 << BITS
    return out


@dataclass
class Model:
    """languages, their log priors and totals, and the n-grams counted in each: row, bucket and number, by row.

    Tables of log P(bucket | language) are made of these for TOGETHER languages at a time, with a last bucket that counts
    nothing; so many languages take more time and not more memory.
    """

    languages: list[str]
    prior: np.ndarray
    totals: np.ndarray
    row: np.ndarray
    bucket: np.ndarray
    n: np.ndarray

    def tables(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first language, table) for all languages."""
        kept = self.__dict__.setdefault("_kept", {})
        for low in range(0, len(self.languages), TOGETHER):
            if low not in kept:
                high = min(low + TOGETHER, len(self.languages))
                a, b = np.searchsorted(self.row, [low, high])
                table = np.full((high - low, (1 << BITS) + 1), np.log(ALPHA))
                table[self.row[a:b] - low, self.bucket[a:b]] = np.log(self.n[a:b] + ALPHA)
                table -= np.log(self.totals[low:high] + ALPHA * (1 << BITS))[:, None]
                table[:, -1] = 0
                if low >= MOST_KEPT * TOGETHER:
                    yield low, table.astype(np.float32)
                    continue
                kept[low] = table.astype(np.float32)
            yield low, kept[low]

    def scores(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text under each language, and its number of n-grams."""
        texts = np.flatnonzero(np.diff(bounds) > 0)
        out, total = np.zeros((len(bounds) - 1, len(self.languages))), np.zeros(len(bounds) - 1, np.int64)
        if not len(texts):
            return out, total
        at = bounds[texts]
        each = [buckets(points, bounds, order) for order in ORDERS]
        for b in each:
            total[texts] += np.add.reduceat((b < 1 << BITS).astype(np.int64), at)
        for low, table in self.tables():
            for b in each:
                for k, row in enumerate(table, low):
                    out[texts, k] += np.add.reduceat(row[b], at, dtype=np.float64)
        return out, total


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Counts of n-grams by language on about `rows` labelled documents, drawn by a hash of doc_id and text, or on all
    where there are fewer; so many labels at most there can be, and the model is no larger than their n-grams. Rows with a
    null lang or text are not labelled rows. An empty table gives a model of no language."""
    tuned(docs.sparkSession)
    labelled = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    total = docs.where(docs["lang"].isNotNull()).count()
    if total > rows:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(17), "text"), F.lit(1 << 20)) < int(rows / total * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names = T.column_of(batch, "lang").dictionary_encode()
            langs, code = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
            for first, points, bounds in T.codepoints(T.column_of(batch, "text")):
                lang = np.repeat(code[first : first + len(bounds) - 1], np.diff(bounds))
                for order in ORDERS:
                    b = buckets(points, bounds, order)
                    for k, name in enumerate(langs):
                        got = np.bincount(b[lang == k], minlength=(1 << BITS) + 1)
                        got[-1] = 0
                        seen[name] = seen[name] + got if name in seen else got
            for k, name in enumerate(langs):  # the last bucket holds the number of documents
                if name in seen:
                    seen[name][-1] += (code == k).sum()
        for name, got in seen.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at].astype(np.int64))], ["lang", "bucket", "n"])

    counts = labelled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts["lang"].combine_chunks().dictionary_encode()
    found = names.dictionary.to_pylist()
    languages = sorted(found)
    where = {x: k for k, x in enumerate(languages)}
    row = np.array([where[x] for x in found], np.int64)[names.indices.to_numpy()] if found else np.zeros(0, np.int64)
    order = np.argsort(row, kind="stable")
    row, bucket, n = row[order], counts["bucket"].to_numpy()[order], counts["n"].to_numpy()[order]
    own = bucket == 1 << BITS
    texts = np.bincount(row[own], n[own], len(languages))
    row, bucket, n = row[~own], bucket[~own], n[~own]
    return Model(languages, np.log(texts / max(1, texts.sum())), np.bincount(row, n, len(languages)), row.astype(np.int32), bucket, n)


def _identified(column: pa.Array, letter: np.ndarray, model: Model, least: float) -> tuple[pa.Array, ...]:
    """Language, confidence, number of n-grams and whether to keep, of each text."""
    k = len(column)
    score, n = np.zeros((k, len(model.languages))), np.zeros(k, np.int64)
    for first, points, bounds in T.codepoints(column):
        score[first : first + len(bounds) - 1], n[first : first + len(bounds) - 1] = model.scores(points, bounds)
    best, sure = np.full(k, -1), np.zeros(k)
    if model.languages:
        score = np.hstack((score + model.prior, (-np.log(1 << BITS) * n)[:, None]))
        best = score.argmax(1)
        sure = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
    known = letter & (best >= 0) & (best < len(model.languages))
    keep = letter if not model.languages else known & (sure >= least)
    names = pa.array([*model.languages, None], pa.string()).take(pa.array(np.where(known, best, len(model.languages))))
    return names, pa.array(np.where(known, sure, 0.0)), pa.array(n), pa.array(keep)


def identify(docs: DataFrame, model: Model, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(doc_id, lang, confidence, n_grams, keep) for every row of docs.

    lang is the language of the highest posterior and confidence that posterior. Beside the languages stands
    a background that gives every bucket the same probability; a text which that explains best is in no known
    language. keep is false, and lang null, for those, and for null, empty or blank texts and texts without
    a letter; keep is also false where confidence is under `least`. Languages that tie go to the first by name.
    Without any labelled row nothing can be rejected but such texts, and lang is null. Rows with a null doc_id
    and repeated rows each give a row. A very long text is scored as a whole. Columns other than doc_id and text are not
    read. An empty table gives none.
    """
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    letters = docs["text"].cast("string").rlike(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = T.column_of(batch, "letters").fill_null(False).to_numpy(zero_copy_only=False)
            names, sure, n, kept = _identified(T.column_of(batch, "text"), letter, sent.value, least)
            yield pa.RecordBatch.from_arrays([T.column_of(batch, "doc_id"), names, sure, n, kept], ["doc_id", "lang", "confidence", "n_grams", "keep"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), letters.alias("letters")).mapInArrow(run, "doc_id long, lang string, confidence double, n_grams long, keep boolean")


def keep(docs: DataFrame, model: Model, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The rows of docs, with all their columns, that identify() keeps; lang is what it found, or what docs has where
    there is no labelled row to know a language by. Nothing is shuffled. Null, empty and very long texts, repeated rows and
    an empty table are as there. Names of other columns don't matter."""
    spark = tuned(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    place = {c: docs.columns.index(c) for c in ("text", "lang")}
    text = docs["text"].cast("string")
    fields = ", ".join(f"{quoted(c)} {'string' if i in place.values() else t}" for i, (c, t) in enumerate(docs.dtypes))
    (letters,), docs_columns = fresh(docs, "_letters"), docs.columns
    rows = docs.select(*(docs[quoted(c)].cast("string").alias(c) if c in place else docs[quoted(c)] for c in docs.columns), text.rlike(r"\p{L}").alias(letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch.column(batch.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False)
            names, _, _, kept = _identified(batch.column(place["text"]), letter, sent.value, least)
            columns = batch.columns[:-1]
            if sent.value.languages:
                columns[place["lang"]] = names
            yield pa.RecordBatch.from_arrays(columns, docs_columns).filter(kept)

    return mapped(rows, run, fields)
