import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmark.llm import packing

SCHEMA = "doc_id long, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_tree_against_a_plain_search(lengths):
    free, want = [], []
    for n in lengths:
        b = next((k for k, room in enumerate(free) if room >= n), len(free))
        if b == len(free):
            free.append(20)
        want.append((b, 20 - free[b]))
        free[b] -= n
    assert list(zip(*packing.first_fit(lengths, 20))) == want


@pytest.mark.parametrize("capacity,group", [(16, 20), (50, 1000)])
def test_every_token_once_and_first_fit_decreasing(spark, capacity, group):
    r = random.Random(capacity)
    rows = [(i, " ".join(r.choice(["a", "b,", "é!"]) for _ in range(r.choice([0, 1, 5, 40, 200])))) for i in range(120)] + [(None, "x y"), (5, "same"), (5, "same"), (7, None), (8, " \n")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), capacity, group).collect()
    want = defaultdict(list)
    for i, t in rows:
        n = len(re.findall(r"\w+|[^\s\w]", t or ""))
        want[i] += [(s, min(capacity, n - s)) for s in range(0, n, capacity)]
    have = defaultdict(list)
    bins = defaultdict(list)
    for x in got:
        have[x.doc_id].append((x.start, x.length))
        bins[x.group_id, x.bin].append((x.offset, x.length))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items() if v}
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for g in {x.group_id for x in got}:
        own = sorted((x.length for x in got if x.group_id == g), reverse=True)
        assert len({x.bin for x in got if x.group_id == g}) == max(packing.first_fit(own, capacity)[0]) + 1


def test_a_rerun_draws_the_same_groups(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(100)], SCHEMA)
    a, b = (sorted(map(tuple, packing.pack(docs.repartition(n), 32, 30).collect())) for n in (1, 4))
    assert a == b


def test_many_copies_of_a_row_and_a_very_long_text(spark):
    docs = spark.range(30_000).selectExpr("7L AS doc_id", "'one and the same row' AS text").unionAll(spark.createDataFrame([(1, "w " * 400_000), (2, None), (None, "")], SCHEMA))
    got = packing.pack(docs, 2048, 500).collect()
    assert sum(r.length for r in got if r.doc_id == 7) == 150_000 and sum(r.length for r in got if r.doc_id == 1) == 400_000
    groups = Counter(r.group_id for r in got if r.doc_id == 7)
    assert len(groups) > 10 and max(groups.values()) <= 5 * packing.TOGETHER
    bins = Counter()
    for r in got:
        bins[r.group_id, r.bin] += r.length
    assert max(bins.values()) <= 2048


def test_empty_table_and_clashing_columns(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, key int, group_id int")
    assert packing.pack(docs).first().length == 2
