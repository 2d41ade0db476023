import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftmark.llm import lm

SCHEMA = "doc_id long, text string"


def stream(text):
    return [int(lm._SYMBOL[b]) for b in text.lower().encode()]


def brute(texts, depth, share, divergence, prior):
    """The score of each text under the tree of all, by dictionaries."""
    n = defaultdict(Counter)
    for t in texts:
        s = [0] * depth + stream(t) + [0]
        for i in range(depth, len(s)) if t else ():
            for d in range(depth + 1):
                n[tuple(s[i - d : i])][s[i]] += 1
    total = sum(n[()].values())
    stays = {()}
    for c, row in n.items():
        m, up = sum(row.values()), n[c[1:]]
        if c and (len(c) == 1 or m >= max(1, share * total)):
            kl = sum(k / m * math.log(k / m / (up[x] / sum(up.values()))) for x, k in row.items())
            if kl >= divergence:
                stays |= {c[j:] for j in range(len(c))}

    def p(c, x):
        below = p(c[1:], x) if c else 1 / lm.SYMBOLS
        return (n[c][x] + prior * below) / (sum(n[c].values()) + prior)

    out = []
    for t in texts:
        s, bits = [0] * depth + stream(t) + [0], 0.0
        for i in range(depth, len(s)) if t else ():
            c = next(tuple(s[i - d : i]) for d in range(depth, -1, -1) if tuple(s[i - d : i]) in stays)
            bits -= math.log2(p(c, s[i]))
        out.append((len(s) - depth - 1, bits))
    return out


@pytest.mark.parametrize("depth,share,divergence", [(3, 0.01, 0.05), (4, 0.0, 0.3), (2, 0.05, 0.0)])
def test_scores_against_dictionaries(spark, depth, share, divergence):
    r = random.Random(depth)
    texts = ["".join(r.choice(["ab", "é", "A b", "the ", "c.", "\n", "9"]) for _ in range(r.randint(0, 60))) for _ in range(40)] + ["", "x", "the the"]
    rows = list(enumerate(texts)) + [(None, texts[3]), (3, texts[3]), (77, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([t or "" for _, t in rows], depth, share, divergence, 16.0)
    got = lm.score(docs, lm.train(docs, depth, share, divergence)).collect()
    assert sorted((str(i), n, round(b, 2)) for (i, _), (n, b) in zip(rows, want)) == sorted((str(r.doc_id), r.n_symbols, round(r.bits, 2)) for r in got)
    assert all((r.bits_per_symbol is None) == (r.n_symbols == 0) for r in got)


def test_many_tasks_and_shares_of_parts(spark, monkeypatch):
    """Counts that go through several sums, and parts that answer in several places, give the same scores."""
    docs = spark.createDataFrame([(i, f"text number {i} of the {i % 7} " * (i % 5 + 1)) for i in range(60)], SCHEMA).repartition(9)
    tree = lm.train(docs)
    want = sorted(map(tuple, lm.score(docs, tree).collect()))
    monkeypatch.setattr(lm, "TOGETHER", 2)
    other = lm.train(docs)
    assert (other.top == tree.top).all() and tree.shares.max() >= 1
    other.shares = np.arange(1, len(other.shares) + 1)
    assert sorted(map(tuple, lm.score(docs, other).collect())) == want
    assert lm.score(docs.unionAll(docs), other).count() == 120


def test_distributions_sum_to_one_and_the_text_is_read_whole(spark):
    docs = spark.createDataFrame([(1, "abc " * 200_000 + "zq"), (2, "hello there")], "doc_id long, text string")
    tree = lm.train(docs)
    assert abs((2.0 ** -tree.bits.reshape(-1, lm.SYMBOLS)).sum(1) - 1).max() < 1e-5
    got = {r.doc_id: r for r in lm.score(docs, tree).collect()}
    assert got[1].n_symbols == 800_002 and got[1].bits_per_symbol < 0.1 < got[2].bits_per_symbol


def test_empty_table_and_extra_columns(spark):
    tree = lm.train(spark.createDataFrame([], SCHEMA))
    assert lm.score(spark.createDataFrame([], SCHEMA), tree).collect() == []
    docs = spark.createDataFrame([(1, "ab", 3, 4)], "doc_id long, text string, bits int, n int")
    assert lm.score(docs, tree).first().bits == pytest.approx(18)


def test_alphabet():
    got = [x for _, s, b in lm.symbols(pa.array(["A1", None, "é"]), 2) for x in (s.tolist(), b.tolist())]
    assert got == [[0, 0, 1, 27, 0, 0, 0, 0, 59, 43 + (0xA9 & 15), 0, 0], [2, 6, 8, 12]]


def test_contexts_stay_when_the_corpus_grows(spark):
    """A context that occurs LEAST times counts as well among texts that are many times as long."""
    rare = "tes eht noc tam nat. " * 25
    kept = []
    for more in (20, 20_000):
        docs = spark.createDataFrame([(1, rare)] + [(2 + k, "the cat sat on the mat. " * more) for k in range(4)], SCHEMA)
        kept.append(next(r.bits_per_symbol for r in lm.score(docs, lm.train(docs)).collect() if r.doc_id == 1))
    assert kept[1] < kept[0] + 0.3, kept
