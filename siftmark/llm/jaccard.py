"""N-gram Jaccard join by MinHash banding.

Documents of the same words are one class, known by 128 bits of these words; from then on only classes are compared.
Classes whose MinHash values agree in all rows of a band meet in a bucket. A pair belongs to the first bucket in which
it meets, so it is verified once, on the full sets of n-grams, and no list of pairs is ever written: a task gives the
links of each class and the edges that connect what it verified.

Buckets are counted before anything is brought together, so those of one class, which are most, go nowhere. One of more
than BLOCK classes is cut into blocks by a hash, and each two blocks are a task's business.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm import text as T
from siftmark.llm.shared import changes, discard, fresh, identity, mapped, materialise, named, tuned, whole, written

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.5, 0.97, 128
TEXTS = 1000  # about so many texts are verified together
BLOCK = 1000  # classes of a bucket of more are taken in blocks, two at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows for which pairs at the threshold meet with probability `recall` or more,
    by at most `most` hashes: 1 - (1 - threshold**rows)**bands >= recall."""
    for rows in range(most, 1, -1):
        p = threshold**rows
        if p > 1e-9 and (bands := 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))) * rows <= most:
            return bands, rows
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(threshold, 1 - 1e-12)))), 1


def gram_hashes(w: T.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts that have a word, where the n-grams of each begin, all n-grams); a text of fewer than n words is one gram."""
    grams, lengths = T.grams(w.hashes, n), np.diff(w.bounds)
    texts = np.flatnonzero(lengths)
    size = np.maximum(1, lengths[texts] - n + 1)
    starts = np.cumsum(size) - size
    out = np.zeros(size.sum(), np.uint64)
    full = lengths[texts] >= n
    if full.any():
        out[np.repeat(full, size)] = grams[T.within(w.bounds, n, len(w.hashes))]
    for t in np.flatnonzero(~full).tolist():
        h = np.uint64(lengths[texts[t]])
        for x in w.hashes[w.bounds[texts[t]] : w.bounds[texts[t] + 1]]:
            h = T.mix(np.array([h], np.uint64) * _GOLD + x)[0]
        out[starts[t]] = h
    return texts, starts, out


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)


def _signatures(bands: int, rows: int, n: int):
    draw = np.random.default_rng(5).integers(0, 1 << 63, (2, bands * rows), dtype=np.int64).astype(np.uint64)
    flip, times = draw[0], draw[1] * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = T.column_of(batch, "id"), T.column_of(batch, "h")
            for w in T.words(T.column_of(batch, "text")):
                texts, starts, grams = gram_hashes(w, n)
                first = w.bounds[texts]
                place = np.arange(len(w.hashes)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
                same = [_sums(T.mix(w.hashes + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(c)), first) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                out = np.empty((len(texts), bands), np.uint64)
                for b in range(bands):
                    h = np.full(len(texts), b, np.uint64)
                    for k in range(b * rows, b * rows + rows):
                        h = T.mix(h * _GOLD + (np.minimum.reduceat((grams ^ flip[k]) * times[k], starts) if len(starts) else h))
                    out[:, b] = h
                key = np.zeros((2, w.texts), np.int64)
                key[:, texts] = np.stack(same).view(np.int64)
                none = np.diff(w.bounds) == 0
                hashes = np.zeros((w.texts, bands), np.int64)
                hashes[texts] = out.view(np.int64)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * w.texts + 1, bands, dtype=np.int32)), pa.array(hashes.ravel()))
                own = [ids.slice(w.first, w.texts), hs.slice(w.first, w.texts)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(k, mask=none) for k in key), buckets], ["id", "h", "hi", "lo", "buckets"])

    return run


def signatures(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, h, hi, lo, buckets) of every row: its identity, the class of its words, null where it has none, and a bucket
    for each band."""
    bands, rows = bands_for(threshold, recall)
    return materialise(docs.select(identity(docs)).mapInArrow(_signatures(bands, rows, n), "id long, h long, hi long, lo long, buckets array<long>"), "signatures")


def classes_of(signed: DataFrame) -> DataFrame:
    """(hi, lo, n, id, h, least, buckets): how many rows a class has, its first row, and its least doc_id."""
    own = signed.where("hi IS NOT NULL").groupBy("hi", "lo")
    out = own.agg(F.count("*").alias("n"), F.min(F.struct("id", "h")).alias("first"), F.min(named(F.col("id"), F.col("h"))).alias("least"), F.first("buckets").alias("buckets"))
    return materialise(out.select("hi", "lo", "n", "first.*", "least", "buckets"), "classes")


def _pairs(table: pa.Table, bands: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places a < b of the pairs of each bucket, or of two blocks of one, that meet there first, about `most` at a time."""
    starts = changes(table, "bucket", "low", "high")
    sizes = np.diff(np.append(starts, table.num_rows))
    band, block, cross = table["band"].to_numpy(), table["block"].to_numpy(), table["low"].to_numpy() != table["high"].to_numpy()
    before = _before(table["before"], bands)
    left = np.concatenate([np.arange(s, s + n) for s, n in zip(starts.tolist(), sizes.tolist())])
    rest = np.repeat(starts + sizes, sizes) - left - 1  # partners after each
    ends = np.cumsum(rest)
    done = 0
    while done < len(left):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, "right")))
        n = rest[done:stop]
        a = np.repeat(left[done:stop], n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        ok = ~cross[a] | (block[a] != block[b])
        a, b = a[ok], b[ok]
        new = _first_meeting(before, band, a, b)
        yield a[new], b[new]
        done = stop


def _first_meeting(before: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of one bucket each share no bucket of an earlier band."""
    new = np.ones(len(a), bool)
    for k in range(int(band.max(initial=0))):
        live = np.flatnonzero(new & (band[a] > k))
        if not len(live):
            break
        new[live[before[a[live], k] == before[b[live], k]]] = False
    return new


def _before(lists: pa.Array, bands: int) -> np.ndarray:
    """The buckets of earlier bands as rows of a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    n = np.diff(bounds)
    out = np.zeros((len(lists), bands), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)] = lists.flatten().to_numpy()
    return out


def _needed(bands: int):
    """Of the classes of each bucket, or two blocks of one, those with a pair that meets there first. Sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, "bucket", "low", "high", rows=50_000):
            use = np.zeros(table.num_rows, bool)
            for a, b in _pairs(table, bands):
                use[a] = use[b] = True
            yield from table.select(_TASK).filter(pa.array(use)).to_batches()

    return run


def _different(a: int, b: int, names: list[str]):
    """The first row of a task for each pair of numbers in the columns a and b; a row of a table may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())
            new = pa.array([not (key in seen or seen.add(key)) for key in keys], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(new) for c in batch.columns], names)

    return run


_LINK = "hi long, lo long, ohi long, olo long, links long"


def _verifier(n: int, threshold: float, bands: int, count: bool):
    """For each class of a task: its links, as a row without another class, and edges that connect those it has links with."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[c].to_numpy() for c in ("lo", "hi", "block", "high", "low", "bucket")])
        table = table.take(pa.array(order)).combine_chunks()
        table = table.take(pa.array(changes(table, "bucket", "low", "high", "block", "hi", "lo"))).combine_chunks()  # rows may be repeated
        hi, lo, weight = (table[c].to_numpy() for c in ("hi", "lo", "n"))
        # every class once, in the order of (hi, lo)
        by = np.lexsort((lo, hi))
        new = np.concatenate(([True], (hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1])))
        node = np.empty(len(hi), np.int64)
        node[by] = np.cumsum(new) - 1
        own = by[new]
        grams, bounds = [], [0]
        for w in T.words(table["text"].take(pa.array(own))):
            _, starts, found = gram_hashes(w, n)
            for g in np.split(found, starts[1:]):
                g = T.distinct(g)
                grams.append(g)
                bounds.append(bounds[-1] + len(g))
        size, bounds = np.diff(bounds), np.array(bounds)
        code = T.ranked(np.concatenate(grams))[1]
        mark = np.zeros(len(code), bool)
        links, root = np.zeros(len(own), np.int64), np.arange(len(own), dtype=np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def apart(one: int, others: np.ndarray) -> np.ndarray:
            mine = find(one)
            others = others[root[others] != mine]
            return others[[find(x) != mine for x in others.tolist()]] if len(others) else others

        for a, b in _pairs(table, bands):
            a, b = node[a], node[b]
            fits = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
            order = np.argsort(a[fits], kind="stable")
            a, b = a[fits][order], b[fits][order]
            cuts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
            for one, others in zip(a[cuts].tolist(), np.split(b, cuts[1:])):
                if not count:  # what is connected already needs no more links
                    others = apart(one, others)
                    if not len(others):
                        continue
                mine = code[bounds[one] : bounds[one + 1]]
                mark[mine] = True
                n_other = size[others]
                at = np.cumsum(n_other) - n_other
                shared = np.add.reduceat(mark[code[np.repeat(bounds[others] - at, n_other) + np.arange(n_other.sum())]], at, dtype=np.int64)
                mark[mine] = False
                near = others[shared >= threshold * (size[one] + n_other - shared)]
                links[one] += weight[own[near]].sum()
                links[near] += weight[own[one]]
                for x in apart(one, near).tolist():
                    p, q = find(one), find(x)
                    root[max(p, q)] = min(p, q)
        top = np.array([find(x) for x in range(len(own))], np.int64)
        some, edge = np.flatnonzero(links), np.flatnonzero(top != np.arange(len(own)))
        first, other = own[np.append(some, edge)], own[top[edge]]
        pad = lambda x: pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(x)])
        return pa.table([pa.array(hi[first]), pa.array(lo[first]), pad(hi[other]), pad(lo[other]), pa.array(np.append(links[some], np.zeros(len(edge), np.int64)))], ["hi", "lo", "ohi", "olo", "links"])

    return run


_TASK = ["hi", "lo", "band", "bucket", "block", "low", "high"]


def _tasks(classes: DataFrame, low: Column, high: Column) -> DataFrame:
    return classes.withColumns({"low": low, "high": high}).select(_TASK)


def _asked(classes: DataFrame, tasks: DataFrame, bands: int) -> DataFrame:
    """(hi, lo, asked) of the classes that have a pair to verify in tasks (hi, lo, band, bucket, block, low, high), which are
    classes of a bucket, or of its blocks low and high. Pairs that meet in a bucket of an earlier band are left to that."""
    key = ["bucket", "low", "high"]
    some = tasks.join(classes.select("hi", "lo", "buckets"), ["hi", "lo"]).select(*_TASK, F.expr("slice(buckets, 1, band)").alias("before"))
    some = some.repartition(*key).sortWithinPartitions(*key, "hi", "lo").mapInArrow(_needed(bands), "hi long, lo long, band int, bucket long, block int, low int, high int")
    return materialise(some.groupBy("hi", "lo").agg(F.collect_list(F.struct("band", *key, "block")).alias("asked")), "asked")


def _texts(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """keys with what classes says of them and the text of each."""
    keys = classes.select("id", "h", "hi", "lo", "n", "buckets").join(keys, ["hi", "lo"])
    found = docs.select(identity(docs)).join(keys.hint("shuffle_hash"), ["id", "h"])
    return found.mapInArrow(_different(found.columns.index("hi"), found.columns.index("lo"), found.columns), found.schema).drop("id", "h")


def _verified(texts: DataFrame, n: int, threshold: float, bands: int, count: bool) -> DataFrame:
    """The links that _verifier finds; texts are rows (hi, lo, n, buckets, text, asked)."""
    sent = texts.select("hi", "lo", "n", "text", "buckets", F.explode("asked").alias("a")).select("hi", "lo", "n", "text", "a.*", F.expr("slice(buckets, 1, a.band)").alias("before"))
    return sent.groupBy("task").applyInArrow(_verifier(n, threshold, bands, count), _LINK)


def links_of(docs: DataFrame, classes: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, count: bool = True, block: int = BLOCK) -> DataFrame:
    """(hi, lo, ohi, olo, links). Rows without ohi say in how many documents of other classes a class has its likes, and
    are to be summed; the others are edges that connect what is connected by verified pairs.

    Without count, links are not to be read, and pairs of classes that are connected already aren't verified. Then each
    block of a large bucket is verified by itself and with the bucket's head, its least class. Only what is not connected
    to the head after that, by whatever bucket, is held against the other blocks; so no pair that connects is left out.
    """
    bands, _ = bands_for(threshold, recall)
    rows = classes.select("hi", "lo", F.posexplode("buckets").alias("band", "bucket"))
    sizes = materialise(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    met = rows.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("lo", "hi"), F.col("blocks")).cast("int")).drop("size")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own, blocks, other = F.col("block"), F.col("blocks"), F.col("other")

    def verified(texts: DataFrame, asked: DataFrame) -> DataFrame:
        parts = max(1, -(-(asked.agg(F.sum(F.size("asked"))).first()[0] or 0) // TEXTS))
        task = F.transform("asked", lambda x: x.withField("task", F.pmod(F.xxhash64(x["bucket"], x["low"], x["high"]), F.lit(parts)).cast("int")))
        return materialise(_verified(texts.withColumn("asked", task), n, threshold, bands, count), "links")

    if count:
        asked = _asked(classes, _tasks(met.withColumn("other", each("blocks")), F.least(own, other), F.greatest(own, other)), bands)
        return verified(_texts(docs, classes, asked), asked)
    large = materialise(met.where("blocks > 1"), "large")
    heads = large.groupBy("bucket", "blocks").agg(F.min(F.struct("hi", "lo", "band")).alias("head"))
    everywhere = heads.select("head.*", "bucket", each("blocks").alias("block"))
    asked = _asked(classes, _tasks(met, own, own).unionByName(_tasks(everywhere, own, own)), bands)
    texts = materialise(_texts(docs, classes, asked.select("hi", "lo").unionAll(large.select("hi", "lo")).distinct()), "texts")
    first = verified(texts.join(asked, ["hi", "lo"]), asked)
    if large.isEmpty():
        return first
    roots = materialise(_roots(first), "roots")
    rooted = lambda df, a, b: df.join(roots.withColumnsRenamed({"hi": a, "lo": b}), [a, b], "left").withColumns({"rhi": F.coalesce("rhi", a), "rlo": F.coalesce("rlo", b)})
    at = rooted(heads.select("bucket", F.col("head.hi").alias("ahi"), F.col("head.lo").alias("alo")), "ahi", "alo").select("bucket", F.col("rhi").alias("bhi"), F.col("rlo").alias("blo"))
    loose = materialise(rooted(large, "hi", "lo").join(at, "bucket").where("rhi <> bhi OR rlo <> blo").select(large.columns), "loose")
    if loose.isEmpty():
        return first
    chunks = loose.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    left = large.join(chunks, "bucket").withColumn("other", each("chunks"))  # all, in their blocks
    right = loose.join(chunks, "bucket").withColumn("other", each("blocks")).withColumn("block", blocks + F.pmod(F.xxhash64("hi", "lo"), "chunks").cast("int"))  # what is loose, as more blocks
    asked = _asked(classes, _tasks(left, own, blocks + other).unionByName(_tasks(right, other, own)), bands)
    return first.unionByName(verified(texts.join(asked, ["hi", "lo"]), asked))


def _roots(links: DataFrame) -> DataFrame:
    """(hi, lo, rhi, rlo) of all classes that are connected to a lesser one: the least of them."""
    node = lambda a, b, name: F.struct(F.col(a).alias("hi"), F.col(b).alias("lo")).alias(name)
    edges = links.where("ohi IS NOT NULL").select(node("hi", "lo", "u"), node("ohi", "olo", "v"))
    return components(edges).select("node.*", F.col("root.hi").alias("rhi"), F.col("root.lo").alias("rlo"))


def _grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(hi, lo, rhi, rlo, n, links) of the classes that hold several documents or are connected to others: the class
    that stands for all that are connected, and how many documents each one of this class is like."""
    roots = _roots(links)
    tops = roots.select(F.col("rhi").alias("hi"), F.col("rlo").alias("lo")).distinct()
    counts = links.where("ohi IS NULL").groupBy("hi", "lo").agg(F.sum("links").alias("links"))
    all_ = roots.unionByName(tops.select("hi", "lo", F.col("hi").alias("rhi"), F.col("lo").alias("rlo"))).join(counts, ["hi", "lo"], "left")
    out = classes.select("hi", "lo", "n", "least").join(all_, ["hi", "lo"], "left").where("n > 1 OR rhi IS NOT NULL")
    return materialise(out.select("hi", "lo", F.coalesce("rhi", "hi").alias("rhi"), F.coalesce("rlo", "lo").alias("rlo"), "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "grouped")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links), a row for every row of docs.

    n_links is the number of other rows that have with it that Jaccard index of their sets of n-grams of words, `threshold`
    or more; rows of the same words, whose index is 1, are among them. What pairs connect, directly or through others, is
    one class, and class_id is the least doc_id in it, null where none has one.

    Of the pairs at the threshold a share of `recall` is found, of those above it more; all that are found are verified
    and counted once, so results grow with the table, whatever the sizes of its groups. A text of fewer than n words has
    one gram, all of it; a very long one is compared as a whole. A null or empty text, or one without words, is like no
    other: it has no links and its own doc_id as its class. Null doc_ids have their row and are counted. Rows repeated in
    the table are rows of one class. Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    tuned(docs.sparkSession)
    signed = signatures(docs, n, threshold, recall)
    classes = classes_of(signed)
    grouped = _grouped(classes, links_of(docs, classes, n, threshold, recall, True, block))
    least = grouped.groupBy("rhi", "rlo").agg(F.min("least").alias("class_id"))
    found = grouped.join(least, ["rhi", "rlo"]).select("hi", "lo", "class_id", "links", F.lit(True).alias("found"))
    doc_id = named(F.col("id"), F.col("h"))
    rows = signed.where("hi IS NOT NULL").select(doc_id.alias("doc_id"), "hi", "lo").join(found, ["hi", "lo"], "left")
    rows = rows.select("doc_id", F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return rows.unionAll(signed.where("hi IS NULL").select(doc_id.alias("doc_id"), doc_id.alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _starry(edges: DataFrame) -> bool:
    """Whether every node has either one greater end of an edge or only lesser ones, so that each v is a root."""
    ends = edges.select("u", F.lit(1).alias("out")).unionAll(edges.select("v", F.lit(0)))
    return ends.groupBy("u").agg(F.sum("out").alias("out"), F.count("*").alias("all")).where("out > 1 OR out = 1 AND all > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (u, v) but the roots: root is the least node that can be reached.

    Large and small stars in turn until all edges lead to roots, each round written to the shared folder and the one
    before it deleted; the number of rounds grows with the logarithm of the longest path. The least neighbour of a node is
    found by an aggregation and joined back, so that one with very many neighbours is no task of its own.
    """
    spark, kind = edges.sparkSession, edges.schema
    pair = lambda a, b: F.struct(a.alias("u"), b.alias("v"))
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _starry(edges := spark.read.schema(kind).parquet(path)):
        both = edges.unionAll(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.where("v > u").join(least, "u").select(v.alias("u"), m.alias("v")).where("u <> v").distinct()
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        new = written(small.select(F.explode(F.array(pair(u, m), pair(v, m))).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        discard(path)
        path = new
    return edges.select(u.alias("node"), v.alias("root"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all their columns, less all but the first document, by doc_id, of each class of join().

    Null doc_ids come last, by a hash of the text. Rows repeated in doc_id and text are one document, of which one row
    stays. Documents without words, null and empty ones too, are in no class, and very long ones are compared as a
    whole. An empty table gives an empty result. Names of other columns don't matter.
    """
    tuned(docs.sparkSession)
    own_id, own_h, mark = fresh(docs, "_id", "_h", "_mark")
    signed = signatures(docs, n, threshold, recall)
    classes = classes_of(signed)
    grouped = _grouped(classes, links_of(docs, classes, n, threshold, recall, False, block))
    first = grouped.select("hi", "lo", "rhi", "rlo").join(classes.select("hi", "lo", "id", "h"), ["hi", "lo"])
    first = first.groupBy("rhi", "rlo").agg(F.min(F.struct("id", "h")).alias("head"))
    found = grouped.select("hi", "lo", "rhi", "rlo").join(first, ["rhi", "rlo"]).select("hi", "lo", "head")
    gone = signed.select("id", "h", "hi", "lo").join(found, ["hi", "lo"]).where("id <> head.id OR h <> head.h").select("id", "h").distinct()
    twice = signed.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select("id", "h")
    marks = gone.withColumn(mark, F.lit(1)).unionByName(twice.join(gone, ["id", "h"], "left_anti").withColumn(mark, F.lit(2)))
    marks = materialise(marks.withColumnsRenamed({"id": own_id, "h": own_h}), "marks")
    own = identity(docs)
    rows = docs.select("*", own[0].alias(own_id), own[1].alias(own_h))
    if marks.where(F.col(mark) == 2).isEmpty():
        return rows.join(marks.hint("shuffle_hash"), [own_id, own_h], "left_anti").drop(own_id, own_h)
    rows = rows.join(marks.hint("shuffle_hash"), [own_id, own_h], "left")
    twice = rows.where(F.col(mark) == 2)
    once = mapped(twice, _different(*(twice.columns.index(c) for c in (own_id, own_h)), twice.columns), twice.schema).dropDuplicates([own_id, own_h])
    return rows.where(F.col(mark).isNull()).unionAll(once).drop(own_id, own_h, mark)


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[k:k+{N - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - {N - 2}))) AS k FROM d WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
near AS (SELECT a, b FROM p JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE k >= {THRESHOLD} * (x.n + y.n - k)),
reach AS (SELECT r, r AS x FROM d UNION SELECT reach.r, near.b AS x FROM reach JOIN near ON near.a = reach.x)
SELECT d.doc_id, (SELECT min(e.doc_id) FROM reach JOIN d e ON e.r = reach.x WHERE reach.r = d.r) AS class_id, (SELECT count(*) FROM near WHERE near.a = d.r) AS n_links FROM d"""
