import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmark.llm import suffixes

SCHEMA = "doc_id long, text string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_against_sorting(s):
    s = [*s, 0]
    assert suffixes.suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_periodic_and_long_texts():
    r = np.random.default_rng(3)
    for s in (np.ones(500, int), np.tile([2, 1, 3, 1], 200), np.tile([1, 2], 300), r.integers(1, 2000, 20_000), np.tile(r.integers(1, 50, 70), 90)):
        s = np.append(s, 0)
        raw = s.astype(">u4").tobytes()
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: raw[4 * i :])


def brute(rows, length):
    rows = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, out = {}, []
    for none, i, t in rows:
        w, last = t.lower().split(), None
        for p in range(len(w) - length + 1):
            g = tuple(w[p : p + length])
            first = seen.setdefault(g, (none, i, t, p))
            if first == (none, i, t, p):
                last = None
            elif last and last[0] == first[:3] and last[1] == first[3] - 1:
                out[-1][2] += 1
                last = (first[:3], first[3])
            else:
                out.append([None if none else i, p, length, None if first[0] else first[1], first[3]])
                last = (first[:3], first[3])
    return sorted(map(tuple, out), key=str)


def got(spark, rows, length, k):
    return sorted((tuple(r) for r in suffixes.repeats(spark.createDataFrame(rows, SCHEMA), length, k).collect()), key=str)


@pytest.mark.parametrize("seed,most", [(0, 2000), (1, 1), (2, 3), (3, 2000), (3, 2)])
def test_passages_against_brute_force(spark, seed, most, monkeypatch):
    """Anchors of more than `most` kinds of runs are cut into blocks."""
    monkeypatch.setattr(suffixes.spans, "__defaults__", (suffixes.LENGTH, suffixes.K, most))
    r = random.Random(seed)
    words = ["w%d" % i for i in range(3 if seed == 3 else 60)]
    shared = [[r.choice(words) for _ in range(r.randint(8, 40))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = []
        while len(w) < r.randint(0, 150):
            w += r.choice(shared) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 12))]
        rows.append((i, " ".join(w)))
    rows += [rows[5], (100, rows[7][1]), (None, rows[8][1]), (None, None), (50, ""), (51, "one two")]
    assert got(spark, rows, 12, 3) == brute(rows, 12)


def test_long_texts_repeated_lines_and_an_empty_table(spark):
    line = " ".join(f"v{i}" for i in range(30))
    rows = [(1, "\n".join([line] * 300)), (2, "\n".join([line] * 4)), (3, " ".join(f"u{i}" for i in range(20_000)))]
    assert got(spark, rows, 50, 10) == brute(rows, 50)
    assert got(spark, [], 50, 10) == []


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x", "u"), (2, "a b c d e f", 6, "y", "u")], "doc_id long, text string, id int, anchor string, `a.b` string")
    assert [tuple(r) for r in suffixes.remove(docs, 5, 2).collect()] == [(1, "a b c d e f", 5, "x", "u")]
    assert [tuple(r) for r in suffixes.repeats(docs, 5, 2).collect()] == [(2, 0, 6, 1, 0)]


def test_a_passage_that_many_documents_share(spark):
    """Each of 20,000 documents has it among words of its own, and 20,000 more are all alike."""
    passage = " ".join(f"p{i}" for i in range(55))
    near = spark.range(20_000).selectExpr("id AS doc_id", f"concat_ws(' ', transform(sequence(1, 30), x -> 'a' || id || 'x' || x), '{passage}', transform(sequence(1, 30), x -> 'b' || id || 'x' || x)) AS text")
    alike = spark.range(20_000).selectExpr("id + 50000 AS doc_id", "concat_ws(' ', transform(sequence(1, 70), x -> 'c' || x)) AS text")
    found = suffixes.repeats(near.unionAll(alike)).groupBy("start", "length", "first_doc_id", "first_start").count().collect()
    assert {tuple(r) for r in found} == {(30, 55, 0, 30, 19_999), (0, 70, 50_000, 0, 19_999)}
