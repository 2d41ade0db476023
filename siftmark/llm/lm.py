"""LM scoring with a probabilistic suffix tree over characters.

Characters are mapped to 63 symbols; the text begins and ends at a 64th. Every document counts: each task counts all
runs of DEPTH + 1 symbols in its part, and these are summed by shuffle, so the counts of shorter contexts follow from those
of longer ones. A context is a candidate where it occurs LEAST times, whatever the size of the corpus, so the tree grows
with it. A candidate stays if its next-symbol distribution diverges from that of its suffix, or a longer context that
stays ends with it.

The tree is never in one place. It is cut into parts by the last NEAR symbols of a context, and a part is a row of a shared
table; only contexts of fewer symbols, 64 ** 2 at most, are on the driver. Different texts are scored once each, in
groups: a group asks each part once for each of its different runs, and the part answers with their bits. Documents are
joined to the scores of their texts by 128 bits, so copies of one text are never brought together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm import text as T
from siftmark.llm.shared import changes, materialise, tuned

DEPTH, BITS, NEAR = 6, 6, 3
TOGETHER = 32  # about so many tasks have their counts summed at once
LEAST, DIVERGENCE, PRIOR = 20, 0.02, 16.0
SYMBOLS = 1 << BITS


def _alphabet() -> np.ndarray:
    """Symbol of each byte of lower-cased UTF-8; 0 is the boundary."""
    out = np.full(256, 42, np.uint8)  # other marks and control characters
    out[[*b"abcdefghijklmnopqrstuvwxyz"]] = np.arange(1, 27)
    out[[*b"0123456789"]] = 27
    out[[*b" \t"]] = 28
    out[[*b"\r\n"]] = 29
    for k, marks in enumerate((b".", b",", b";:", b"!", b"?", b"'\"", b"-_", b"()[]{}", b"/\\|", b"#$%&*", b"@", b"=<>+")):
        out[[*marks]] = 30 + k
    out[0x80:0xC0] = 43 + (np.arange(64) & 15)
    out[0xC0:0xE0] = 59
    out[0xE0:0xF0] = 60
    out[0xF0:] = 61
    return out


_SYMBOL = _alphabet()


def symbols(column: pa.Array | pa.ChunkedArray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, stream, where each text begins in it), chunk by chunk. `depth` boundaries come
    before and after each text; from begin[i] to begin[i + 1] - depth lie its symbols and one boundary after these is its end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first, part in T.chunks(column):
        data, at = T._buffer(pc.utf8_lower(part.fill_null("")))
        begin = at + depth * np.arange(1, len(at) + 1)
        stream = np.zeros(begin[-1], np.uint8)
        stream[np.arange(len(data)) + np.repeat(begin[:-1] - at[:-1], np.diff(at))] = _SYMBOL[data]
        yield first, stream, begin


def _grams(stream: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """The depth + 1 symbols up to each symbol or end of a text."""
    own = np.ones(len(stream), bool)
    for k in range(1, depth):
        own[begin[1:] - depth + k] = False
    own[: begin[0]] = False
    n = len(stream) - depth
    out = np.zeros(n, np.int64)
    for k in range(depth + 1):
        out <<= BITS
        out |= stream[k : k + n]
    return out[own[depth:]]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _pack(x: np.ndarray) -> bytes:
    """Bytes of ascending or small numbers, like places together."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols."""
    return keys & ((1 << BITS * n) - 1)


def _by_part(grams: np.ndarray, near: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, which grams are its) of the parts that have some; the grams of a context of near or more symbols are in one."""
    part = (T.mix(_low(grams >> BITS, near).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        yield k, order[at[k] : at[k + 1]]


def _count(depth: int, near: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        waiting, size = [], 0

        def settle() -> None:
            nonlocal waiting, size
            if waiting:
                k, n = T.counted(np.concatenate(waiting))
                keys.append(k)
                counts.append(n)
                waiting, size = [], 0
            if len(keys) > 8:
                keys[:], counts[:] = map(lambda x: [x], _summed(np.concatenate(keys), np.concatenate(counts)))

        for batch in batches:
            for _, stream, begin in symbols(T.column_of(batch, "text"), depth):
                waiting.append(_grams(stream, begin, depth))
                size += len(waiting[-1])
                if size > 2_000_000:
                    settle()
        settle()
        k, n = _summed(np.concatenate(keys), np.concatenate(counts))
        task = TaskContext.get().partitionId()
        for part, own in _by_part(k, near, parts):
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "part": pa.array([part], pa.int32()), "grams": [_pack(_steps(k[own]))], "counts": [_pack(n[own])]})

    return run


def _counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Grams and counts of rows of them, summed whenever there are many."""
    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for g, n in zip(table["grams"], table["counts"]):
        held.append((np.cumsum(_unpack(g.as_py())), _unpack(n.as_py())))
        size += len(held[-1][0])
        if size > 2_000_000:
            held, size = [_summed(*map(np.concatenate, zip(*held)))], 0
    return _summed(*map(np.concatenate, zip(*held)))


def _sum(table: pa.Table) -> pa.Table:
    keys, counts = _counted(table)
    return pa.table({"task": table["task"][:1], "part": table["part"][:1], "grams": [_pack(_steps(keys))], "counts": [_pack(counts)]})


def _shortened(near: int):
    """Counts of the last near symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, counts = _counted(pa.Table.from_batches([batch]))
                keys, counts = _summed(_low(keys, near), counts)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["gram", "n"])

    return run


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, ascending, and how often each occurs."""
    return _summed(keys >> BITS, counts)


def _diverges(keys: np.ndarray, counts: np.ndarray, d: int, up: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each context of d symbols, the divergence of its next symbol from that of its suffix, whose counts are in up."""
    contexts, total = _totals(keys, counts)
    up_contexts, up_total = _totals(*up)
    row = np.searchsorted(contexts, keys >> BITS)
    p = counts / total[row]
    q = up[1][np.searchsorted(up[0], _low(keys, d))] / up_total[np.searchsorted(up_contexts, _low(keys >> BITS, d - 1))]
    return np.bincount(row, p * np.log(p / q), len(contexts))


def _grow(depth: int, near: int, short: tuple[np.ndarray, np.ndarray], least: float, divergence: float):
    """The contexts of near to depth symbols that stay, with their counts, of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                levels = {depth: _counted(row)}
                for d in range(depth - 1, near - 1, -1):
                    levels[d] = _summed(_low(levels[d + 1][0], d + 1), levels[d + 1][1])
                below = np.zeros(0, np.int64)
                for d in range(depth, near - 1, -1):
                    keys, counts = levels[d]
                    contexts, total = _totals(keys, counts)
                    stays = (total >= least) & (_diverges(keys, counts, d, levels[d - 1] if d > near else short) >= divergence)
                    stays[np.searchsorted(contexts, below)] = True
                    own = stays[np.searchsorted(contexts, keys >> BITS)]
                    below = T.distinct(_low(contexts[stays], d - 1))
                    if own.any():
                        yield pa.RecordBatch.from_pydict({"part": batch.column("part").slice(i, 1), "depth": pa.array([d], pa.int32()), "grams": [_pack(_steps(keys[own]))], "counts": [_pack(counts[own])]})

    return run


def _suffixes(near: int):
    """The suffixes of near - 1 symbols of the contexts of near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column("grams").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(T.distinct(_low(np.cumsum(_unpack(g)) >> BITS, near - 1)))], ["context"])

    return run


@dataclass
class Tree:
    """top[c * SYMBOLS + s] is P(s) after c, near - 1 symbols, by the longest context of no more that stays; nodes has the
    counts of longer ones by part. A part of more grams than others answers in as many places as shares says."""

    depth: int
    near: int
    parts: int
    prior: float
    top: np.ndarray
    nodes: DataFrame
    shares: np.ndarray

    @property
    def bits(self) -> np.ndarray:
        """-log2 P of top."""
        return -np.log2(self.top)


def _top(levels: list[tuple[np.ndarray, np.ndarray]], below: np.ndarray, least: float, divergence: float, prior: float) -> np.ndarray:
    """levels[d]: counts of d context symbols and the next one; below are contexts of the last level that stay for longer ones."""
    stays = [np.zeros(0, bool)] * len(levels)
    for d in range(len(levels) - 1, 0, -1):
        contexts, total = _totals(*levels[d])
        stays[d] = ((total >= least) | (d == 1)) & (_diverges(*levels[d], d, levels[d - 1]) >= divergence)
        stays[d][np.searchsorted(contexts, below)] = True
        below = np.unique(_low(contexts[stays[d]], d - 1))
    top = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for d, (keys, counts) in enumerate(levels):
        n = np.zeros((SYMBOLS**d, SYMBOLS))
        n.ravel()[keys] = counts
        up = top[np.arange(SYMBOLS**d) & (len(top) - 1)]
        use = np.zeros(len(n), bool)
        use[_totals(keys, counts)[0][stays[d]] if d else 0] = True
        top = np.where(use[:, None], (n + prior * up) / (n.sum(1, keepdims=True) + prior), up)
    return top.ravel()


def train(docs: DataFrame, depth: int = DEPTH, share: float | None = None, divergence: float = DIVERGENCE, prior: float = PRIOR, least: int = LEAST) -> Tree:
    """The tree of all documents, with the contexts that occur `least` times; where a share of all positions is given,
    that counts instead."""
    spark = tuned(docs.sparkSession)
    parts, near = int(spark.conf.get("spark.sql.shuffle.partitions")), min(NEAR, depth)
    kept = "task int, part int, grams binary, counts binary"
    runs = docs.select(docs["text"].cast("string").alias("text")).where("text <> ''").mapInArrow(_count(depth, near, parts), kept)
    few = parts // TOGETHER
    while few > 1:  # so that no task sums what very many have counted
        runs = runs.groupBy("part", F.pmod("task", F.lit(few))).applyInArrow(_sum, kept)
        few //= TOGETHER
    runs = materialise(runs.groupBy("part").applyInArrow(_sum, kept), "grams")
    sizes = runs.groupBy("part").agg(F.sum(F.octet_length("grams")).alias("n")).toArrow()
    shares = np.ones(parts, np.int64)
    shares[sizes["part"].to_numpy()] = np.ceil(sizes["n"].to_numpy() / max(1.0, 1.5 * np.mean(sizes["n"].to_numpy() if sizes.num_rows else [1])))
    short = runs.mapInArrow(_shortened(near), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    levels = [(short["gram"].to_numpy(), short["n"].to_numpy())]
    for d in range(near - 2, -1, -1):
        levels.insert(0, _summed(_low(levels[0][0], d + 1), levels[0][1]))
    bound = float(least) if share is None else max(1.0, share * levels[0][1].sum())
    nodes = materialise(runs.mapInArrow(_grow(depth, near, levels[-1], bound, divergence), "part int, depth int, grams binary, counts binary"), "nodes")
    below = nodes.where(F.col("depth") == near).mapInArrow(_suffixes(near), "context long").distinct().toArrow()["context"].to_numpy()
    return Tree(depth, near, parts, prior, _top(levels, np.sort(below), bound, divergence, prior), nodes, shares)


def _distinct(column: pa.ChunkedArray, depth: int) -> np.ndarray:
    held, size = [np.zeros(0, np.int64)], 0
    for _, stream, begin in symbols(column, depth):
        held.append(T.distinct(_grams(stream, begin, depth)))
        size += len(held[-1])
        if size > 4_000_000:
            held = [T.distinct(np.concatenate(held))]
            size = 0
    return T.distinct(np.concatenate(held))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different texts of a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keys = zip(T.column_of(batch, "a").to_pylist(), T.column_of(batch, "b").to_pylist())
        yield batch.filter(pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_()))


def _ask(depth: int, near: int, parts: int, shares: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        grams = _distinct(table["text"], depth)
        asked = [(k, _pack(_steps(grams[own]))) for k, own in _by_part(grams, near, parts)]
        own = table["own"][0].as_py()
        share = [own % int(shares[k]) for k, _ in asked]
        return pa.table({"own": pa.array([own] * len(asked), pa.int32()), "share": pa.array(share, pa.int32()), "part": pa.array([k for k, _ in asked], pa.int32()), "grams": pa.array([g for _, g in asked], pa.binary())})

    return run


def _answer(depth: int, near: int, prior: float, sent):
    """Bits of the grams that are asked of a part, from its contexts."""

    def run(asked: pa.Table, nodes: pa.Table) -> pa.Table:
        levels = {d: _counted(nodes.filter(pc.equal(nodes["depth"], d))) for d in set(nodes["depth"].to_pylist())}
        totals = {d: _totals(*x) for d, x in levels.items()}
        out = []
        for g in asked["grams"].to_pylist():
            grams = np.cumsum(_unpack(g))
            p = sent.value[_low(grams, near)]
            live = np.arange(len(grams))
            for d in range(near, depth + 1):
                if d not in levels or not len(live):
                    break
                (keys, counts), (contexts, total) = levels[d], totals[d]
                key = _low(grams[live], d + 1)
                at = np.minimum(np.searchsorted(contexts, key >> BITS), len(contexts) - 1)
                on = contexts[at] == key >> BITS
                live, key, at = live[on], key[on], at[on]
                has = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                p[live] = (np.where(keys[has] == key, counts[has], 0) + prior * p[live]) / (total[at] + prior)
            out.append((-np.log2(p)).astype(np.float32).tobytes())
        return pa.table({"own": asked["own"], "part": asked["part"], "bits": pa.array(out, pa.binary())})

    return run


def _score(depth: int, near: int, parts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        held, sizes = [], []
        order = np.lexsort((docs["b"].to_numpy(), docs["a"].to_numpy()))
        new = changes(docs.select(["a", "b"]).take(pa.array(order)), "a", "b")
        docs = docs.take(pa.array(order[new]))
        for _, stream, begin in symbols(docs["text"], depth):
            held.append(T.ranked(_grams(stream, begin, depth)))
            sizes.append(np.diff(begin) - depth)
        grams = np.zeros(0, np.int64)
        for low in range(0, len(held), 16):
            grams = T.distinct(np.concatenate([grams, *(u for u, _ in held[low : low + 16])]))
        got = dict(zip(answers["part"].to_pylist(), answers["bits"].to_pylist()))
        bits = np.zeros(len(grams), np.float32)
        for k, own in _by_part(grams, near, parts):
            bits[own] = np.frombuffer(got[k], np.float32)
        sums = []
        for (u, at), n in zip(held, sizes):
            each = bits[np.searchsorted(grams, u)][at]
            sums.append(np.where(n > 0, np.add.reduceat(each, np.cumsum(n + 1) - n - 1, dtype=np.float64), 0.0))
        n, total = np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0), *sums])
        return pa.table({"a": docs["a"], "b": docs["b"], "bits": pa.array(total), "n_symbols": pa.array(n)})

    return run


def score(docs: DataFrame, tree: Tree) -> DataFrame:
    """(doc_id, bits_per_symbol, bits, n_symbols) for every row of docs; bits is -log2 P of the text with its end, and
    bits_per_symbol, the score, is its share of a symbol.

    A very long text is scored as a whole. A null or empty text has 0 symbols, 0 bits and a null bits_per_symbol. Rows with a null doc_id and repeated
    rows each give a row. Columns other than doc_id and text are not read. An empty table gives an empty result,
    and trained on one the tree gives every symbol the same probability.
    """
    spark = tuned(docs.sparkSession)
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = docs["text"].cast("string")
    a, b = F.xxhash64(text).alias("a"), F.xxhash64(F.lit(71), text).alias("b")
    rows = docs.select(a, b, text.alias("text")).where("text <> ''").mapInArrow(_once, "a long, b long, text string")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int"))
    asked = rows.groupBy("own").applyInArrow(_ask(tree.depth, tree.near, tree.parts, tree.shares), "own int, share int, part int, grams binary")
    answer = _answer(tree.depth, tree.near, tree.prior, spark.sparkContext.broadcast(tree.top))
    shares = spark.createDataFrame(list(enumerate(tree.shares.tolist())), "part int, shares int")  # as many rows as parts
    nodes = tree.nodes.join(F.broadcast(shares), "part").select(*tree.nodes.columns, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    answers = asked.groupBy("part", "share").cogroup(nodes.groupBy("part", "share")).applyInArrow(answer, "own int, part int, bits binary")
    scores = rows.groupBy("own").cogroup(answers.groupBy("own")).applyInArrow(_score(tree.depth, tree.near, tree.parts), "a long, b long, bits double, n_symbols long")
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), a, b).join(scores, ["a", "b"], "left")
    return found.select("doc_id", (F.col("bits") / F.col("n_symbols")).alias("bits_per_symbol"), F.coalesce("bits", F.lit(0.0)).alias("bits"), F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols"))
