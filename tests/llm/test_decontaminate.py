import math
import random

import pytest

from siftmark.llm import decontaminate

DOCS, TESTS = "doc_id long, text string", "item_id long, text string"


def brute(docs, tests, n, share, slack):
    out = []
    for i, test in tests:
        q = (test or "").lower().split()
        if not q:
            continue
        size, terms = min(n, len(q)), set(q)
        asked = {tuple(q[k : k + size]) for k in range(len(q) - size + 1)}
        least, span = math.ceil(share * len(terms) - 1e-9), math.ceil(slack * len(q) - 1e-9)
        for d, text in docs:
            w = (text or "").lower().split()
            at = [k for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in asked]
            near = max((len(terms & set(w[k : k + span])) for k in range(len(w))), default=0)
            if at or near >= least:
                out.append((d, i, len({tuple(w[k : k + size]) for k in at}), at[0] if at else None, near if near >= least else None, "phrase" if at else "proximity"))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,most,shard", [(1, 10**6, 10**6), (2, 10, 1), (3, 25, 60)])
def test_matches_rounds_and_shards_against_brute_force(spark, seed, most, shard):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(25)]
    tests = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 9)))) for k in range(8)] + [(None, "w1 w2"), (9, None), (10, "")]
    docs = []
    for d in range(40):
        w = [r.choice(words) for _ in range(r.randint(0, 30))]
        if r.random() < 0.4:
            w[3:3] = r.choice(tests[:8])[1].split()
        docs.append((d, " ".join(w)))
    docs += [(None, tests[0][1]), (3, docs[3][1]), (50, None), (51, "")]
    a, b = spark.createDataFrame(docs, DOCS).repartition(2), spark.createDataFrame(tests, TESTS)
    got = sorted((tuple(x) for x in decontaminate.matches(a, b, 4, 0.8, 1.5, most, shard).collect()), key=str)
    assert got == brute(docs, tests, 4, 0.8, 1.5) and len(got) > 10
    hit = {x[0] for x in got}
    kept = sorted((x.doc_id for x in decontaminate.clean(a, b, 4, 0.8, 1.5, most, shard).collect() if x.doc_id is not None))
    assert kept == sorted(d for d, _ in docs if d is not None and d not in hit)


def test_long_texts_empty_tables_and_other_columns(spark):
    passage = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, "x " * 300_000 + passage, 1, "u"), (2, "y " * 10, 1, "u")], DOCS + ", item_id int, `a.b` string")
    tests = spark.createDataFrame([(7, passage)], TESTS)
    assert [(r.doc_id, r.item_id, r.first_pos) for r in decontaminate.matches(docs, tests).collect()] == [(1, 7, 300_000)]
    assert decontaminate.clean(docs, tests).columns == docs.columns
    assert decontaminate.matches(docs, tests.where("false")).collect() == [] and decontaminate.matches(docs.where("false"), tests).collect() == []
    assert decontaminate.clean(docs, tests.where("false")).count() == 2


def test_many_tests_at_once(spark):
    """As many phrase and proximity queries as terms, against brute force; a test that is one frequent word is one too."""
    r = random.Random(9)
    words = ["w%d" % k for k in range(120)]
    tests = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 12, 40])))) for k in range(150)]
    docs = [(d, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for d in range(60)] + [(100 + k, " ".join(r.sample(tests[k][1].split(), len(tests[k][1].split())))) for k in range(40)]
    found = decontaminate.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(tests, TESTS))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, tests, 8, 0.8, 1.5)
