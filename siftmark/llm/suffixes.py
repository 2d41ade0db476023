"""Suffix-array dedup: passages that an earlier place of the table already has, word for word.

Every window of `length` words owns an anchor, the least hashed k-gram in it (the rightmost of several). What the
window holds determines it, so equal windows meet under one anchor, wherever they are. Consecutive windows with the
same anchor are a run, and runs of the same words a kind, known by 128 bits. Anchors of one run, which are most, are
left out first. Then each kind is known by its first place, found by an aggregation, so copies of a passage are never
brought together, however many there are. Where an anchor has one kind, as inside of copies, nothing else is needed.
Where it has several, the text of the first place of each is fetched, and a suffix array over these, made by linear
grouping, finds the windows that they share. An anchor of very many kinds is cut into blocks, each sorted by itself, and
the windows that are left of each block meet by 128 bits of their words.

No text goes to a task for a passage that occurs once, and no task holds the places of a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm import text as T
from siftmark.llm.shared import changes, fresh, identity, mapped, materialise, named, tuned, whole

LENGTH, K = 50, 10
RUNS = 2000  # about so many kinds of runs have their suffixes sorted together, and at most so many of one anchor
_LOW = np.uint64(0xFFFFFFFF)
SPAN = "id long, h long, pos int, n int, fid long, fh long, fpos int"


def suffix_array(s: np.ndarray) -> list[int]:
    """Order of the suffixes of s, whose last symbol must be less than all others, by linear grouping.

    Suffixes lie in groups by a prefix, at first one symbol. Groups are taken in descending order; each suffix of
    one points to the nearest before it that is in a lower group, and those pointed to move up into groups of
    their own, by how often they are: their prefix now goes on to what points to them. In the end a group's prefix is the
    longest Lyndon prefix of its suffixes. Then, in ascending order, each sorted suffix i places i - 1 and the
    chain of its pointers at the next free places of their groups.
    """
    n = len(s)
    by_symbol = np.argsort(s, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], s[by_symbol][1:] != s[by_symbol][:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, n))
    at = np.empty(n, np.int64)
    at[by_symbol] = np.arange(n)
    order, place = by_symbol.tolist(), at.tolist()
    group = np.repeat(new, sizes)[at].tolist()  # where a suffix's group starts in order
    size = [0] * n  # by a group's start
    for start, z in zip(new.tolist(), sizes.tolist()):
        size[start] = z
    before = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            j = i - 1
            while j >= 0 and group[j] > start:
                j = before[j]
            before[i] = j
            if j >= 0:  # j moves to the end of its group, which ends by one earlier
                g = group[j]
                z = size[g] - 1
                if z:
                    to, at = g + z, place[j]
                    if to != at:
                        other = order[to]
                        order[at], order[to] = other, j
                        place[other], place[j] = at, to
                    size[g], size[to], group[j] = z, 1, to
        else:
            times: dict[int, int] = {}
            for i in sorted(order[start:end]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            by: dict[int, dict[int, list[int]]] = {}
            for j, k in times.items():
                by.setdefault(k, {}).setdefault(group[j], []).append(j)
            for k in sorted(by, reverse=True):
                for g, moved in by[k].items():
                    z = size[g] - len(moved)
                    if not z:
                        continue
                    to = g + z
                    for t, j in enumerate(moved, to):
                        # every place from t on that is not yet filled holds a suffix of this group
                        at, other = place[j], order[t]
                        if at != t:
                            order[at], order[t] = other, j
                            place[other], place[j] = at, t
                    for j in moved:
                        group[j] = to
                    size[g], size[to] = z, len(moved)
        end = start
    free = list(range(n))  # by a group's start, its next free place
    placed = bytearray(n)
    placed[n - 1] = 1
    out = [n - 1] * n
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return out


def equal_windows(texts: list[np.ndarray], length: int) -> np.ndarray:
    """A number for each window of `length` words of the texts, one after the other, the same where windows agree."""
    sizes = np.array([len(t) for t in texts])
    counts = sizes - length + 1
    starts = np.cumsum(sizes + 1) - sizes - 1  # a separator after each
    code = T.ranked(np.concatenate(texts))[1]
    s = np.ones(sizes.sum() + len(texts) + 1, np.int64)
    inside = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    s[inside] = code + 2
    s[-1] = 0
    order = np.array(suffix_array(s))
    index = np.full(len(s), -1)  # number of the window that begins here
    index[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())] = np.arange(counts.sum())
    order = order[index[order] >= 0]
    same = np.flatnonzero(s[order[1:]] == s[order[:-1]])
    for k in range(1, length):  # adjacent suffixes that agree in `length` words
        same = same[s[order[same + 1] + k] == s[order[same] + k]]
    new = np.ones(len(order), np.int64)
    new[same + 1] = 0
    out = np.empty(len(order), np.int64)
    out[index[order]] = np.cumsum(new) - 1
    return out


def _runs(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = (T.column_of(batch, c).to_numpy() for c in ("id", "h"))
            for w in T.words(T.column_of(batch, "text")):
                total = len(w.hashes)
                if total < length:
                    continue
                g = T.grams(w.hashes, k)
                least = T.sliding_min((g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64)), length - k + 1)
                at = np.flatnonzero(T.within(w.bounds, length, total))
                if not len(at):
                    continue
                least = least[at]
                first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))))
                n = np.diff(np.append(first, len(at)))
                begin = at[first]
                text = np.searchsorted(w.bounds, begin, "right") - 1
                stop = begin + n + length - 1
                up, down = T._power_tables(total + 1)
                sums = np.zeros(total + 1, np.uint64)
                np.cumsum(w.hashes * up[:total], out=sums[1:])
                kind = T.mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
                anchor = g[(_LOW - (least[first] & _LOW)).astype(np.int64)]
                doc = w.first + text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(ids[doc]), pa.array(hs[doc]), pa.array((begin - w.bounds[text]).astype(np.int32)), pa.array(n.astype(np.int16))],
                    ["anchor", "kind", "id", "h", "pos", "n"],
                )

    return run


_ASKED = ["anchor", "kind", "n", "id", "h", "pos", "block", "hot"]
_FETCHED = "anchor long, kind long, n int, id long, h long, pos int, block int, hot boolean, words array<long>"
_PIECE = "anchor long, kind long, offset int, n int, fid long, fh long, fpos int, hot boolean, whi long, wlo long"


def _fetch(length: int):
    """The words of each asked run; rows are (document, asked runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(T.column_of(batch, "id").to_pylist(), T.column_of(batch, "h").to_pylist()))
            new = [not (x in seen or seen.add(x)) for x in keys]  # a document's row may be repeated
            batch = batch.filter(pa.array(new, pa.bool_()))
            asked = T.column_of(batch, "asked")
            bounds = asked.offsets.to_numpy() - asked.offsets[0].as_py()
            runs = asked.flatten()
            pos, n = (runs.field(c).to_numpy() for c in ("pos", "n"))
            for w in T.words(T.column_of(batch, "text")):
                low, high = bounds[w.first], bounds[w.first + w.texts]
                doc = np.searchsorted(bounds, np.arange(low, high), "right") - 1 - w.first
                begin = w.bounds[doc] + pos[low:high]
                size = n[low:high] + length - 1
                take = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(w.hashes[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(runs.field(c).slice(low, high - low) for c in _ASKED), words], [*_ASKED, "words"])

    return run


def _hashed(words: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """128 bits of the windows of `length` words that begin at begin, [2, windows]."""
    out = []
    for salt in (0, 0x9E3779B97F4A7C15):
        x = T.mix(words.view(np.uint64) + np.uint64(salt))
        up, down = T._power_tables(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        out.append(T.mix((sums[begin + length] - sums[begin]) * down[begin]).view(np.int64))
    return np.stack(out)


def _sorter(length: int):
    """The parts of each run with the first place of their windows among the runs of the task. Of a hot anchor each window is
    a part, and where it is its own first place it has its hash."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[c].to_numpy() for c in ("pos", "h", "id")])
        table = table.take(pa.array(order)).combine_chunks()
        table = table.take(pa.array(changes(table, "id", "h", "pos"))).combine_chunks()  # a document's row may be repeated
        n, id, h, pos = (table[c].to_numpy().astype(np.int64) for c in ("n", "id", "h", "pos"))
        lists = table["words"].chunk(0)
        bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        words = lists.flatten().to_numpy()
        window = equal_windows(np.split(words, bounds[1:-1]), length)
        # of the places of a window, the first by document and position
        run = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((pos[run] + offset, h[run], id[run], window))
        head = np.concatenate(([True], window[order][1:] != window[order][:-1]))
        first = np.empty(len(run), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        fid, fh, fpos = id[run[first]], h[run[first]], pos[run[first]] + offset[first]
        hot = table["hot"].to_numpy()[run]
        new = np.concatenate(([True], (run[1:] != run[:-1]) | hot[1:] | (fid[1:] != fid[:-1]) | (fh[1:] != fh[:-1]) | (fpos[1:] != fpos[:-1] + 1)))
        at = np.flatnonzero(new)
        own = hot[at] & (first[at] == at)
        key = np.zeros((2, len(at)), np.int64)
        if own.any():
            key[:, own] = _hashed(words, bounds[run[at[own]]] + offset[at[own]], length)
        anchor, kind = (table[c].to_numpy()[run[at]] for c in ("anchor", "kind"))
        small = lambda x: pa.array(x.astype(np.int32))
        columns = [pa.array(anchor), pa.array(kind), small(offset[at]), small(np.diff(np.append(at, len(run)))), pa.array(fid[at]), pa.array(fh[at]), small(fpos[at]), pa.array(hot[at]), *(pa.array(x, mask=~own) for x in key)]
        return pa.table(columns, [c.split()[0] for c in _PIECE.split(", ")])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that go on where another ends, in both places, become one. Sorted by id, h, fid, fh, shift and pos."""
    for table in whole(batches, "id", "h"):
        table = table.take(pa.array(changes(table, "id", "h", "fid", "fh", "shift", "pos")))  # once for repeated rows
        col = {c: table[c].to_numpy() for c in table.column_names}
        end = col["pos"] + col["n"]
        new = np.zeros(table.num_rows, bool)
        new[changes(table, "id", "h", "fid", "fh", "shift")] = True
        new[1:] |= col["pos"][1:] != end[:-1]
        at = np.flatnonzero(new)
        stop = end[np.append(at[1:], len(new)) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(col["id"][at]), pa.array(col["h"][at]), pa.array(col["pos"][at]), pa.array((stop - col["pos"][at]).astype(np.int32)), *(pa.array(col[c][at]) for c in ("fid", "fh", "fpos"))], ["id", "h", "pos", "n", "fid", "fh", "fpos"])


def _settled(pieces: DataFrame) -> DataFrame:
    """Parts of hot anchors with the first place of their windows over all blocks."""
    place = F.struct(F.col("fid").alias("id"), F.col("fh").alias("h"), F.col("fpos").alias("pos"))
    heads = pieces.where("whi IS NOT NULL").select("whi", "wlo", "fid", "fh", "fpos", place.alias("place"))
    best = heads.groupBy("whi", "wlo").agg(F.min("place").alias("best"))
    moved = heads.drop("place").join(best, ["whi", "wlo"]).select("fid", "fh", "fpos", "best")
    return pieces.join(moved, ["fid", "fh", "fpos"]).select("anchor", "kind", "offset", "n", F.col("best.id").alias("fid"), F.col("best.h").alias("fh"), F.col("best.pos").alias("fpos"))


def spans(docs: DataFrame, length: int = LENGTH, k: int = K, most: int = RUNS) -> DataFrame:
    """(id, h, pos, n, fid, fh, fpos): n windows from word pos on that are first seen from word fpos of document fid on."""
    tuned(docs.sparkSession)
    runs = docs.select(identity(docs)).mapInArrow(_runs(length, k), "anchor long, kind long, id long, h long, pos int, n short")
    if not docs.select(identity(docs)[:2]).groupBy("id", "h").count().where("count > 1").isEmpty():
        runs = runs.distinct()
    runs = materialise(runs, "runs")
    again = materialise(runs.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    runs = materialise(runs.join(again, "anchor", "left_semi"), "met")
    kinds = runs.groupBy("anchor", "kind").agg(F.count("*").alias("times"), F.min(F.struct("id", "h", "pos")).alias("head"), F.first("n").cast("int").alias("n"))
    kinds = materialise(kinds.select("anchor", "kind", "times", "head.*", "n"), "kinds")
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    kinds = kinds.join(many, "anchor", "left")
    alone = kinds.where("kinds IS NULL AND times > 1").select("anchor", "kind", F.lit(0).alias("offset"), "n", F.col("id").alias("fid"), F.col("h").alias("fh"), F.col("pos").alias("fpos"))
    blocks = F.ceil(F.col("kinds") / most)
    asked = kinds.where("kinds IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("kind"), blocks).cast("int")).withColumn("hot", blocks > 1)
    asked = materialise(asked.groupBy("id", "h").agg(F.collect_list(F.struct(_ASKED)).alias("asked")), "asked")
    tasks = max(1, -(-(asked.agg(F.sum(F.size("asked"))).first()[0] or 0) // most))
    once = docs.select(identity(docs)).join(asked.hint("shuffle_hash"), ["id", "h"]).select("id", "h", "text", "asked")
    fetched = once.mapInArrow(_fetch(length), _FETCHED).withColumn("task", F.pmod(F.xxhash64("anchor", "block"), F.lit(tasks)).cast("int"))
    mixed = materialise(fetched.groupBy("task").applyInArrow(_sorter(length), _PIECE), "pieces")
    pieces = alone.unionByName(mixed.where("NOT hot").select(alone.columns))
    hot = mixed.where("hot")
    if not hot.isEmpty():
        pieces = pieces.unionByName(_settled(hot))
    parts = runs.drop("n").join(pieces, ["anchor", "kind"]).withColumn("pos", F.col("pos") + F.col("offset"))
    parts = parts.where("id <> fid OR h <> fh OR pos <> fpos").select("id", "h", "pos", "n", "fid", "fh", "fpos", (F.col("pos") - F.col("fpos")).alias("shift"))
    return parts.repartition("id", "h").sortWithinPartitions("id", "h", "fid", "fh", "shift", "pos").mapInArrow(_joined, SPAN)


def repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc_id, start, length, first_doc_id, first_start): `length` words from word `start` of a document on are first
    found from word `first_start` of `first_doc_id` on, which may be the same document.

    A passage is reported where each of its windows of `length` words, 50 for production, has an earlier equal;
    documents come in the order of doc_id, null last, and words in that of the text. Passages that overlap but
    are first found in different places are rows of their own. Documents of one doc_id but different texts go by a
    hash of the text, and so do those of none; rows repeated in doc_id and text are one document. Null and
    empty texts and those of fewer words have no passage; very long ones are taken as a whole. Columns other than doc_id
    and text are not read. An empty table gives an empty result.
    """
    out = spans(docs, length, k)
    return out.select(named(F.col("id"), F.col("h")).alias("doc_id"), F.col("pos").alias("start"), (F.col("n") + length - 1).alias("length"), named(F.col("fid"), F.col("fh")).alias("first_doc_id"), F.col("fpos").alias("first_start"))


def _without(column: pa.Array, cuts: pa.Array, length: int) -> tuple[pa.Array, np.ndarray]:
    """The texts without the words of their cuts, and whether any word is left."""
    bounds = np.append(0, np.cumsum(pc.list_value_length(cuts).to_numpy()))
    spans = cuts.flatten()
    pos, n = (spans.field(c).to_numpy() for c in ("pos", "n"))
    pieces, left = [], []
    for w in T.words(pc.ascii_lower(column), lower=False):  # bytes stay where they are
        low, high = bounds[w.first], bounds[w.first + w.texts]
        doc = np.searchsorted(bounds, np.arange(low, high), "right") - 1 - w.first
        begin = w.bounds[doc] + pos[low:high]
        edge = np.zeros(len(w.hashes) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + n[low:high] + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0  # by word
        text = w.text_of()
        turn = (gone[1:] != gone[:-1]) | (text[1:] != text[:-1])
        first, last = np.flatnonzero(gone & np.append(True, turn)), np.flatnonzero(gone & np.append(turn, True))
        drop = np.zeros(len(w.data) + 1, np.int64)
        drop[w.starts[first]] += 1
        drop[w.ends[last]] -= 1
        keep = np.cumsum(drop[:-1]) == 0
        keep[w.at[1:] - 1] = False  # the line break that words() puts after each text
        size = np.add.reduceat(keep.astype(np.int64), w.at[:-1])
        raw, _ = T._buffer(pc.binary_join_element_wise(column.slice(w.first, w.texts), "", "\n"))
        pieces.append(pa.StringArray.from_buffers(w.texts, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(raw[keep])))
        left.append(np.bincount(text[~gone], minlength=w.texts) > 0)
    return pa.concat_arrays(pieces), np.concatenate(left)


def _cut(names: list[str], index: int, length: int, count: int | None):
    """Drops the spans of each row's last column from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(batch.num_columns - 1)
            columns = batch.columns[:-1]
            has = pc.greater(pc.list_value_length(cuts), 0)
            if not pc.any(has).as_py():
                yield pa.RecordBatch.from_arrays(columns, names)
                continue
            new, left = _without(columns[index].filter(has), cuts.filter(has), length)
            columns[index] = pc.replace_with_mask(columns[index], has, new)
            if count is not None:
                columns[count] = pc.replace_with_mask(columns[count], has, pc.utf8_length(new).cast(columns[count].type))
            stays = pc.replace_with_mask(pc.invert(has), has, pa.array(left))
            yield pa.RecordBatch.from_arrays(columns, names).filter(stays)

    return run


def remove(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """The rows of docs, with all their columns, whose texts lack the words of all passages of repeats().

    The marks and blanks between dropped words go with them. n_chars, where docs has it as a number, is counted
    anew. A document of which no word is left is dropped; one without such passages stays as it is, null and
    empty texts too. An empty table gives an empty result. Names of other columns don't matter.
    """
    own_id, own_h, own_cuts = fresh(docs, "_id", "_h", "_cuts")
    found = spans(docs, length, k).groupBy("id", "h").agg(F.collect_list(F.struct("pos", "n")).alias(own_cuts)).withColumnsRenamed({"id": own_id, "h": own_h})
    found = materialise(found, "cuts")  # a table of its own, so that rows which are repeated very often can be split in the join
    id, h, _ = identity(docs)
    rows = docs.select("*", id.alias(own_id), h.alias(own_h)).join(found.hint("shuffle_hash"), [own_id, own_h], "left").drop(own_id, own_h)
    rows = rows.withColumn(own_cuts, F.coalesce(own_cuts, F.array().cast("array<struct<pos:int,n:int>>")))
    count = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None
    return mapped(rows, _cut(docs.columns, docs.columns.index("text"), length, count), docs.schema)


SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS r, doc_id, regexp_extract_all(lower(text), '{T.WORD}') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
x AS (SELECT r, doc_id, unnest(range(1, len(w) - {LENGTH - 2})) AS k, w FROM d WHERE len(w) >= {LENGTH}),
g AS (SELECT r, doc_id, k, array_to_string(w[k:k+{LENGTH - 1}], ' ') AS g FROM x),
f AS (SELECT r, doc_id, k, first_value(r) OVER o AS fr, first_value(doc_id) OVER o AS fdoc, first_value(k) OVER o AS fk FROM g WINDOW o AS (PARTITION BY g ORDER BY r, k)),
i AS (SELECT *, k - row_number() OVER (PARTITION BY r, fr, k - fk ORDER BY k) AS island FROM f WHERE r <> fr OR k <> fk)
SELECT any_value(doc_id) AS doc_id, (min(k) - 1)::INT AS start, (count(*) + {LENGTH - 1})::INT AS length, any_value(fdoc) AS first_doc_id, (min(fk) - 1)::INT AS first_start
FROM i GROUP BY r, fr, k - fk, island"""
