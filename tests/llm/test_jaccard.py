import itertools
import random
import re
from collections import Counter

import pytest

from siftmark.llm import jaccard, shared

SCHEMA = "doc_id long, text string"


def grams(text, n):
    w = re.findall(r"[0-9a-z_\x80-\U0010FFFF]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=jaccard.N, t=jaccard.THRESHOLD):
    sets = [(i, grams(x, n)) for i, x in rows]
    return sorted(tuple(sorted((i, j))) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and len(a & b) / len(a | b) >= t)


def wanted(rows, n=jaccard.N, t=jaccard.THRESHOLD):
    """[(doc_id, class_id, n_links)] of rows whose doc_ids differ, by comparing all pairs."""
    pairs = brute(rows, n, t)
    links, own = Counter(x for p in pairs for x in p), {i: i for i, _ in rows}
    for g in groups_by_pairs(pairs):
        own |= {x: g[0] for x in g}
    return sorted((i, own[i], links[i]) for i, _ in rows)


def corpus(seed, bases=12, copies=6):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for _ in range(bases):
        base = [r.choice(words) for _ in range(r.randint(3, 120))]
        for c in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(0, len(w) // 12)) if c else 0):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    return rows


SURE = 0.999999  # so that no pair is missed


def got(docs, **how):
    return sorted((tuple(r) for r in jaccard.join(docs, **how).collect()), key=str)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3, 1])
def test_classes_and_links_against_all_pairs(spark, block):
    rows = corpus(1)
    assert got(spark.createDataFrame(rows, SCHEMA), recall=SURE, block=block) == sorted(wanted(rows), key=str)


@pytest.mark.parametrize("recall", [SURE, jaccard.RECALL])
def test_documents_of_the_tables(spark, recall):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {x[0]: x for x in wanted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])}
    have = {x[0]: x for x in got(docs, recall=recall)}
    assert set(have) == set(want) and all(have[i][2] <= want[i][2] and have[i][1] >= want[i][1] for i in want)
    assert have == want if recall == SURE else sum(x[2] for x in have.values()) >= 0.9 * sum(x[2] for x in want.values())


def test_nulls_ties_repeats_short_and_empty(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, "a b c"), (2, "A, b. C!"), (2, "a b c"), (None, "a b c"), (3, None), (4, ""), (5, " ,. "), (6, "a b"), (7, long), (8, long + " y"), (7, long), (None, "all alone"), (None, None)]
    docs = spark.createDataFrame([(i, x, 1, "q", "u") for i, x in rows], "doc_id long, text string, id int, bucket string, `meta.url` string")
    want = [(1, 1, 3), (2, 1, 3), (2, 1, 3), (None, 1, 3), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 2), (7, 7, 2), (8, 7, 2), (None, None, 0), (None, None, 0)]
    assert got(docs) == sorted(want, key=str)


def test_many_copies_and_a_line_that_many_share(spark):
    """100,000 copies of a text under 2,000 doc_ids and no two alike of 3,000 near copies: every row, and none in one task."""
    base = " ".join(f"w{i}" for i in range(40))
    copies = spark.range(100_000).selectExpr("id % 2000 AS doc_id", f"'{base}' AS text")
    near = spark.range(3_000).selectExpr("id + 5000 AS doc_id", "concat_ws(' ', transform(sequence(0, 59), x -> 'v' || x), 'own' || id) AS text")
    out = jaccard.join(copies.unionAll(near), block=500).groupBy("class_id", "n_links").count().collect()
    assert {tuple(r) for r in out} == {(0, 99_999, 100_000), (5000, 2_999, 3_000)}
    kept = jaccard.keep_one(copies.unionAll(near), block=500).collect()
    assert sorted(r.doc_id for r in kept) == [0, 5000]


def test_null_doc_ids_of_different_texts_stay_apart(spark):
    docs = spark.range(400_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'text ' || id AS text")
    own = docs.select(shared.identity(docs))
    assert own.select("id", "h").distinct().count() == 400_000 and own.select(shared.named(own["id"], own["h"]).alias("d")).where("d IS NOT NULL").isEmpty()
    few = docs.limit(3_000)
    assert jaccard.keep_one(few).count() == 3_000 and jaccard.keep_one(few.unionAll(few)).count() == 3_000
    assert own.agg({"id": "min"}).first()[0] >= shared.NONE


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).collect() == []
    assert jaccard.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("t", [0.3, 0.5, 0.7, 0.9, 1.0])
def test_band_choice(t):
    bands, rows = jaccard.bands_for(t)
    assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - t**rows) ** bands >= jaccard.RECALL - 1e-9


def test_components_of_a_long_path(spark):
    edges = [((i + 1, 0), (i, 0)) for i in range(40)] + [((101, 0), (100, 0))]
    got = jaccard.components(spark.createDataFrame(edges, "u struct<id:long,h:int>, v struct<id:long,h:int>")).collect()
    assert {(r.node.id, r.root.id) for r in got} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


@pytest.mark.parametrize("block", [jaccard.BLOCK, 4, 1])
def test_keep_one_of_each_group(spark, block):
    rows = corpus(2, 6, 5) + [(900, None), (901, ""), (900, None), (None, "only one here"), (None, "only one here")]
    docs = spark.createDataFrame([(i, x, "t", "u") for i, x in rows], "doc_id long, text string, _id string, `a.b` string")
    gone = {i for i, c, _ in wanted([x for x in rows if x[1] and x[0] is not None]) if i != c}
    kept = jaccard.keep_one(docs, recall=SURE, block=block)
    assert kept.columns == docs.columns
    have = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()))
    want = sorted({(i is None, i or 0, x or "") for i, x in rows if i not in gone})
    assert have == want


def groups_by_pairs(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = {}
    for x in sorted(root):
        out.setdefault(find(x), []).append(x)
    return list(out.values())
