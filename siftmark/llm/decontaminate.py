"""Benchmark decontamination by a distributed positional inverted index.

The index is a table in the shared folder, sharded by document. A shard holds some documents of about SHARD tokens
together: all their terms, how often each occurs, and the ascending positions of its tokens. It is written once, nothing
of the corpus is shuffled, and all that comes after reads the index and not the texts. The frequencies of the tests' terms
are summed over all shards first, so what is rarest is so in the whole corpus.

Phrases. Each run of `n` words of a test (the whole test where it is shorter) is a phrase query. It starts from the
shard's postings of its rarest term, moved by that term's offset, and is intersected with the moved postings of the
next rarest, until all terms have agreed or no position is left. All queries are worked off together.

Proximity. A test with t different terms also matches where some window of slack * length tokens holds a share of
`share` of them, in any order. Such a window must hold one of the rarest t - ceil(share * t) + 1 terms, so only
windows about the postings of those are looked at, those of all tests together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm import text as T
from siftmark.llm.shared import fresh, identity, materialise, named, tuned

N, SHARE, SLACK = 8, 0.8, 1.5
ROUND_WORDS = 1_000_000  # words of tests that are sent to the shards at once; more take several rounds over the index
SHARD = 1_000_000
SCHEMA = "doc_id long, item_id long, phrases int, first_pos int, near_terms int, match string"
_INDEX = "ids binary, hs binary, starts binary, terms binary, counts binary, postings binary"
_POS = np.int64((1 << 40) - 1)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of numbers, like places together."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def _unpack(x: bytes, kind: type = np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def shard() -> pa.RecordBatch:
            ids, hs, n, words = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(words, kind="stable")
            terms = words[order]
            new = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
            steps = np.diff(order, prepend=0)
            steps[new] = order[new]  # the first posting of a term is a position, the others are steps
            columns = [ids, hs, np.cumsum(n) - n, terms[new].view(np.int64), np.diff(np.append(new, len(terms))), steps]
            return pa.RecordBatch.from_arrays([pa.array([_pack(x)], pa.binary()) for x in columns], [c.split()[0] for c in _INDEX.split(", ")])

        for batch in batches:
            ids, hs = (T.column_of(batch, c).to_numpy() for c in ("id", "h"))
            for w in T.words(T.column_of(batch, "text")):
                held.append((ids[w.first : w.first + w.texts], hs[w.first : w.first + w.texts], np.diff(w.bounds), w.hashes))
                total += len(w.hashes)
                if total >= size:
                    yield shard()
                    held, total = [], 0
        if held:
            yield shard()

    return run


def index(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """The positional index of docs, a row for each shard, written to the shared folder."""
    return materialise(docs.select(identity(docs)).mapInArrow(_shards(size), _INDEX), "index")


@dataclass
class Tests:
    """Terms of the tests by rank of their hash, phrase queries over them, and each test's set of terms."""

    vocabulary: np.ndarray
    items: pa.Array
    phrases: list[tuple[np.ndarray, np.ndarray]]  # by length: (item of each, [queries, length] of terms)
    terms: np.ndarray  # of all items, one after the other
    bounds: np.ndarray
    lengths: np.ndarray
    df: np.ndarray | None = None  # of each term in the whole corpus

    def least(self, share: float) -> np.ndarray:
        return np.ceil(share * np.diff(self.bounds) - 1e-9).astype(np.int64)

    def seeds(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(item, term) of the rarest terms of each test, of which a window with `share` of its terms must have one."""
        item = np.repeat(np.arange(len(self.lengths)), np.diff(self.bounds))
        order = np.lexsort((self.terms, self.df[self.terms], item))
        rank = np.arange(len(item)) - self.bounds[:-1][item]
        keep = rank < (np.diff(self.bounds) - self.least(share) + 1)[item]
        return item[keep], self.terms[order][keep]


def prepare(ids: pa.Array, w: T.Words, n: int) -> Tests:
    """Of tests with one word or more."""
    vocabulary, code = np.unique(w.hashes, return_inverse=True)
    lengths = np.diff(w.bounds)
    phrases = []
    for size in np.unique(np.minimum(lengths, n)).tolist():
        start = np.flatnonzero(T.within(w.bounds, size, len(code)))
        item = np.searchsorted(w.bounds, start, "right") - 1
        own = np.minimum(lengths[item], n) == size
        rows = np.unique(np.column_stack((item[own], code[start[own, None] + np.arange(size)])), axis=0)
        phrases.append((rows[:, 0].copy(), rows[:, 1:].astype(np.int32)))
    pairs = np.unique(w.text_of() * len(vocabulary) + code)
    return Tests(vocabulary, ids, phrases, pairs % len(vocabulary), np.searchsorted(pairs // len(vocabulary), np.arange(len(lengths) + 1)), lengths)


class Shard:
    """The postings that a shard has of the terms of the tests."""

    def __init__(self, row: dict, tests: Tests, gap: int):
        """Positions count the shard's tokens, with `gap` free ones between texts."""
        terms, counts = _unpack(row["terms"], np.uint64), _unpack(row["counts"])
        self.first = _unpack(row["starts"])
        self.starts = self.first + gap * np.arange(len(self.first))
        rank = np.searchsorted(tests.vocabulary, terms)
        rank[rank == len(tests.vocabulary)] = 0
        mine = np.flatnonzero(tests.vocabulary[rank] == terms)
        self.df = np.zeros(len(tests.vocabulary), np.int64)
        self.df[rank[mine]] = counts[mine]
        self.bounds = np.append(0, np.cumsum(self.df))
        steps = _unpack(row["postings"])
        begin = (np.cumsum(counts) - counts)[mine]
        n = counts[mine]
        at = np.cumsum(steps[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())])
        at -= np.repeat(np.append(0, at[np.cumsum(n)[:-1] - 1]) if len(n) else n, n)
        at += gap * (np.searchsorted(self.first, at, "right") - 1)
        self.keys = (np.repeat(rank[mine].astype(np.int64), n) << 40) | at  # term by term, as ranks go with hashes

    def text_at(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into term, position) of all postings of each term."""
        n = self.df[term]
        which = np.repeat(np.arange(len(term)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return which, self.keys[self.bounds[term][which] + within] & _POS

    def phrases(self, queries: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, position of its first word) of all occurrences."""
        live = np.flatnonzero(self.df[queries].min(1) > 0)
        terms = queries[live]
        rarest = np.argsort(df[terms], axis=1, kind="stable")  # offsets, the rarest term's first
        query, position = self.postings(terms[np.arange(len(live)), rarest[:, 0]])
        start = position - rarest[query, 0]
        for k in range(1, queries.shape[1]):
            offset = rarest[query, k]
            key = (terms[query, offset].astype(np.int64) << 40) | np.maximum(start + offset, 0)
            i = np.searchsorted(self.keys, key)
            i[i == len(self.keys)] = 0
            ok = (self.keys[i] == key) & (start >= 0) if len(self.keys) else np.zeros(len(key), bool)
            query, start = query[ok], start[ok]
        return live[query], start

    def near(self, tests: Tests, seeds: tuple[np.ndarray, np.ndarray], least: np.ndarray, span: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, text, most different terms in a window of its span) where that is the item's least or more."""
        which, at = self.postings(seeds[1])
        item = seeds[0][which]
        size = np.diff(tests.bounds)
        ends = np.cumsum(size[item])
        done = 0
        while done < len(item):  # about `most` look-ups at a time
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, "right")))
            own, p = item[done:stop], at[done:stop]
            done = stop
            n = size[own]
            seed = np.repeat(np.arange(len(own)), n)
            term = tests.terms[np.arange(n.sum()) + np.repeat(tests.bounds[own] - np.cumsum(n) + n, n)]
            low = np.searchsorted(self.keys, (term << 40) | np.maximum(p - span[own] + 1, 0)[seed])
            high = np.searchsorted(self.keys, (term << 40) | (p + span[own])[seed])
            there = np.bincount(seed[high > low], minlength=len(own)) >= least[own]
            live = np.flatnonzero(there[seed] & (high > low))
            if not len(live):
                continue
            # the tokens of each place, by position
            n = (high - low)[live]
            token = self.keys[np.repeat(low[live] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            place = np.repeat(seed[live], n)
            order = np.lexsort((token & _POS, place))
            place, token = place[order], token[order]
            key = (place << 40) | (token & _POS)
            first = np.searchsorted(key, key - span[own[place]] + 1)
            n = np.arange(len(key)) - first + 1
            last = np.flatnonzero(n >= least[own[place]])  # windows that end here
            n = n[last]
            window = np.repeat(np.arange(len(last)), n)
            terms = token[np.repeat(first[last] - np.cumsum(n) + n, n) + np.arange(n.sum())] >> 40
            different = np.bincount(np.unique(window * len(tests.vocabulary) + terms) // len(tests.vocabulary), minlength=len(last))
            enough = different >= least[own[place[last]]]
            last = last[enough]
            yield own[place[last]], self.text_at(token[last] & _POS), different[enough]


def search(row: dict, tests: Tests, share: float, slack: float) -> pa.Table:
    """(text, item, phrases, first_pos, near_terms) of the texts of a shard and the tests that match, by text and item."""
    span = np.ceil(slack * tests.lengths - 1e-9).astype(np.int64)
    shard = Shard(row, tests, int(max(span.max(), tests.lengths.max())) + 2)
    k = len(tests.items)
    found = []
    for item, queries in tests.phrases:
        query, start = shard.phrases(queries, tests.df)
        text = shard.text_at(start)
        found.append((text * k + item[query], query, start - shard.starts[text]))
    key, query, at = (np.concatenate(x) for x in zip(*found))  # an item's queries are all of one length
    order = np.lexsort((at, query, key))
    key, query, at = key[order], query[order], at[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    other = new.copy()
    other[1:] |= query[1:] != query[:-1]
    pair = np.flatnonzero(new)
    phrases = np.add.reduceat(other.astype(np.int64), pair) if len(pair) else pair
    first = np.minimum.reduceat(at, pair) if len(pair) else pair
    close = [(text * k + item, n) for item, text, n in shard.near(tests, tests.seeds(share), tests.least(share), span)]
    near, terms = (np.concatenate(x) for x in zip(*close)) if close else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((-terms, near))
    near, terms = near[order], terms[order]
    best = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1]))) if len(near) else np.zeros(0, np.int64)
    near, terms = near[best], terms[best]
    all_ = np.union1d(key[pair], near)
    columns = [pa.array(all_ // k), pa.array(all_ % k)]
    for keys, values in ((key[pair], phrases), (key[pair], first), (near, terms)):
        where = np.searchsorted(keys, all_)
        where[where == len(keys)] = 0
        has = keys[where] == all_ if len(keys) else np.zeros(len(all_), bool)
        columns.append(pa.array(values[where].astype(np.int32) if len(keys) else np.zeros(len(all_), np.int32), mask=~has))
    return pa.table(columns, ["text", "item", "phrases", "first_pos", "near_terms"])


def rounds(benchmark: DataFrame, n: int, most: int = ROUND_WORDS) -> Iterator[Tests]:
    """The different tests that have a word, by item_id, in portions of at most about `most` words."""
    picked = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text <> ''").distinct()
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0

    def portion() -> Iterator[Tests]:
        column = pa.array(texts, pa.large_string())
        w = T.words_of_all(column)
        some = np.flatnonzero(np.diff(w.bounds))
        if len(some):
            w.bounds = np.append(w.bounds[some], w.bounds[-1])  # texts without words take no place
            yield prepare(pa.array(ids, pa.int64()).take(pa.array(some)), w, n)

    for row in picked.orderBy("item_id", "text").toLocalIterator(prefetchPartitions=True):
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"]) // 6 + 1  # about so many words
        if size >= most:
            yield from portion()
            ids, texts, size = [], [], 0
    if texts:
        yield from portion()


def _frequencies(shards: DataFrame, tests: Tests) -> np.ndarray:
    """How often each term of the tests is in the corpus; only the terms and counts of the index are read."""
    sent = shards.sparkSession.sparkContext.broadcast(tests.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, counts in zip(T.column_of(batch, "terms").to_pylist(), T.column_of(batch, "counts").to_pylist()):
                terms, counts = _unpack(terms, np.uint64), _unpack(counts)
                at = np.searchsorted(terms, sent.value)
                at[at == len(terms)] = 0
                n += np.where(terms[at] == sent.value, counts[at], 0) if len(terms) else 0
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])

    got = shards.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(tests.vocabulary), np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


_FOUND = "id long, h long, item_id long, phrases int, first_pos int, near_terms int"


def found(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, slack: float = SLACK, most: int = ROUND_WORDS, shard: int = SHARD) -> DataFrame:
    """(id, h, item_id, phrases, first_pos, near_terms) of all rows of docs and tests that match, written to the shared folder."""
    spark = tuned(docs.sparkSession)
    shards, out = None, spark.createDataFrame([], _FOUND)
    for tests in rounds(benchmark, n, most):
        shards = index(docs, shard) if shards is None else shards
        tests.df = _frequencies(shards, tests)
        out = out.unionAll(materialise(shards.mapInArrow(_searcher(spark.sparkContext.broadcast(tests), share, slack), _FOUND), "found"))
    return out


def _searcher(sent, share: float, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: T.column_of(batch, c)[i].as_py() for c in batch.schema.names}
                got = search(row, sent.value, share, slack).combine_chunks()
                own = [pa.array(_unpack(row[c])).take(got["text"]) for c in ("ids", "hs")]
                yield from pa.table([*own, sent.value.items.take(got["item"]), *(got[c] for c in ("phrases", "first_pos", "near_terms"))], [c.split()[0] for c in _FOUND.split(", ")]).to_batches()

    return run


def matches(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, slack: float = SLACK, most: int = ROUND_WORDS, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, phrases, first_pos, near_terms, match), a row for each document and test that match.

    phrases counts the test's different n-word phrases found, first_pos is the word at which the first begins (null
    where none does), near_terms is the most of its terms in a window (null if under `share` of them). match is
    "phrase" if there is a phrase, else "proximity". Tests of no word ask for nothing; one with a null item_id is asked
    and reported with null; two tests of one item_id are asked separately, and rows repeated in the benchmark once.
    Null and empty documents match nothing, and very long ones are searched as a whole. Rows with a null doc_id and
    repeated rows are each searched and reported. Other columns are not read. If either table is empty so is the result.
    """
    got = found(docs, benchmark, n, share, slack, most, shard)
    phrases = F.coalesce("phrases", F.lit(0))
    return got.select(named(F.col("id"), F.col("h")).alias("doc_id"), "item_id", phrases.alias("phrases"), "first_pos", "near_terms", F.when(phrases > 0, "phrase").otherwise("proximity").alias("match"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, slack: float = SLACK, most: int = ROUND_WORDS, shard: int = SHARD) -> DataFrame:
    """The rows of docs, with all their columns, that match no test in the sense of matches().

    Null and empty texts stay, and so does everything where the benchmark is empty; an empty table gives an empty
    result. Names of other columns don't matter. What goes is written first, so the join knows its size: Spark sends it
    to all tasks up to its threshold and else shuffles.
    """
    own_id, own_h = fresh(docs, "_id", "_h")
    gone = found(docs, benchmark, n, share, slack, most, shard).select(F.col("id").alias(own_id), F.col("h").alias(own_h)).distinct()
    own = identity(docs)
    return docs.select("*", own[0].alias(own_id), own[1].alias(own_h)).join(materialise(gone, "gone"), [own_id, own_h], "left_anti").drop(own_id, own_h)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT DISTINCT i, len(w[k:k+{N - 1}]) AS n, array_to_string(w[k:k+{N - 1}], ' ') AS g FROM (SELECT i, w, unnest(range(1, greatest(2, len(w) - {N - 2}))) AS k FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM q),
p AS (SELECT r, k, n, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
ph AS (SELECT r, i, count(DISTINCT q.g) AS phrases, min(k) - 1 AS first_pos FROM p JOIN q USING (n, g) GROUP BY r, i),
terms AS (SELECT DISTINCT i, unnest(w) AS t FROM b),
need AS (SELECT i, ceil({SHARE} * count(*) - 1e-9) AS least, ceil({SLACK} * any_value(b.n) - 1e-9) AS span FROM terms JOIN (SELECT i, len(w) AS n FROM b) b USING (i) GROUP BY i),
tok AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM d),
hit AS (SELECT r, i, t, k FROM tok JOIN terms USING (t)),
cand AS (SELECT r, i FROM hit JOIN need USING (i) GROUP BY r, i HAVING count(DISTINCT t) >= any_value(least)),
few AS (SELECT hit.* FROM hit JOIN cand USING (r, i)),
win AS (SELECT x.r, x.i, x.k, count(DISTINCT y.t) AS near_terms FROM few x JOIN need USING (i) JOIN few y ON y.r = x.r AND y.i = x.i AND y.k >= x.k AND y.k < x.k + span GROUP BY x.r, x.i, x.k),
nr AS (SELECT r, i, max(near_terms) AS near_terms FROM win JOIN need USING (i) WHERE near_terms >= least GROUP BY r, i)
SELECT doc_id, item_id, coalesce(phrases, 0)::INT AS phrases, first_pos::INT AS first_pos, near_terms::INT AS near_terms, CASE WHEN phrases > 0 THEN 'phrase' ELSE 'proximity' END AS match
FROM ph FULL JOIN nr USING (r, i) JOIN d USING (r) JOIN b USING (i)"""
