import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmark.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string"


def test_pairwise_identity():
    r = np.random.default_rng(0)
    table = r.normal(size=(1 << Q.BITS, 2 * (1 + Q.RANK))).astype(np.float32)
    bucket, value, bounds = r.integers(0, 1 << Q.BITS, 30), r.normal(size=30).astype(np.float32), np.array([0, 7, 8, 30])
    got = Q.Machine(np.array([0.5, -1.0]), table).logits(bucket, value, bounds)
    for t in range(3):
        own = range(bounds[t], bounds[t + 1])
        for h, bias in enumerate((0.5, -1.0)):
            rows = table[:, h * (1 + Q.RANK) : (h + 1) * (1 + Q.RANK)].astype(float)
            want = bias + sum(rows[bucket[i], 0] * value[i] for i in own)
            want += sum(rows[bucket[i], 1:] @ rows[bucket[j], 1:] * value[i] * value[j] for i in own for j in own if i < j)
            assert got[t, h] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    machine = Q.train(docs, labels.where(~held))
    got = Q.classify(docs, machine).join(labels.where(held).withColumnRenamed("quality", "q").withColumnRenamed("toxic", "t"), "doc_id").toPandas()
    assert len(got) > 800
    assert ((got.quality >= 0.5) == (got.q == 1)).mean() > 0.97
    assert got.keep[(got.q == 1) & (got.t == 0)].mean() > 0.97
    assert 1 - got.keep[(got.q == 1) & (got.t == 1)].mean() > 0.4  # 280 toxic texts are few to learn from


def test_nulls_blanks_repeats_and_missing_columns(spark):
    rows = [(1, "good words here", "en", None), (None, "good words", None, "s"), (1, "good words here", "en", None), (2, None, "en", "s"), (3, "", "en", "s"), (4, "x " * 200_000, "en", "s")]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, 1, 0), (4, 0, None), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, Q.train(docs, labels)).collect()
    assert len(got) == 6 and all(not r.keep and r.quality == 0 for r in got if r.doc_id in (2, 3))
    assert len({(r.quality, r.toxic) for r in got if r.doc_id == 1}) == 1
    none = Q.classify(docs.drop("lang", "source").withColumn("bucket", F.lit(1)), Q.train(docs, labels.where("false"))).collect()
    assert all(r.keep == (r.doc_id not in (2, 3)) for r in none)
    assert Q.classify(docs.where("false"), None).collect() == []


def test_at_most_so_many_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}", "en", "s") for i in range(50)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    a, b = (Q.train(docs.repartition(n), labels.repartition(n), rows=20) for n in (1, 3))
    assert (a.table == b.table).all() and (a.bias == b.bias).all()


def test_rare_words_count(spark):
    """An insult of four labelled texts raises toxicity."""
    r = np.random.default_rng(4)
    plain = [" ".join(r.choice(["one", "two", "three", "four", "five", "six"], 8)) for _ in range(202)]
    rows = [(i, t + " blockhead" * (i < 4 or i == 201), "en", "s") for i, t in enumerate(plain[:201] + [plain[200]])]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i < 4)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.toxic for x in Q.classify(docs, Q.train(docs, labels)).collect()}
    assert got[201] > 1.5 * got[200], (got[200], got[201])
    labels = spark.createDataFrame([(i, 1, int(i < 4)) for i in range(200)], "doc_id long, quality int, toxic int")
    few = {x.doc_id: x.toxic for x in Q.classify(docs, Q.train(docs, labels, rows=40)).collect()}
    assert few[201] > 1.5 * few[200] and few[200] < 0.2, (few[200], few[201])


def test_a_step_of_fit_against_numeric_slopes(monkeypatch):
    """One step on all texts, against slopes of the loss by differences of pairwise sums, with unknown labels and weights."""
    for name, x in (("BITS", 4), ("RANK", 2), ("EPOCHS", 1), ("STEPS", 0), ("DECAY", 0.0)):
        monkeypatch.setattr(Q, name, x)
    r = np.random.default_rng(5)
    bounds = np.array([0, 3, 4, 9, 12])
    bucket = np.concatenate([r.choice(16, n, replace=False) for n in np.diff(bounds)]).astype(np.int32)
    value, labels, weights = r.uniform(0.2, 1, 12).astype(np.float32), np.array([[1, 0], [0, -1], [-1, 1], [0, 0]]), np.array([1.0, 3.0, 2.0, 2.0])
    start = np.random.default_rng(3).normal(0, 0.02, (16, 6)).astype(np.float32).astype(float)
    start[:, ::3] = 0
    texts = np.bincount(bucket, minlength=16)
    trust = texts / (texts + Q.DOUBT)
    share, known = weights / weights.mean(), labels >= 0
    rate = ((np.where(known, labels, 0) * share[:, None]).sum(0) + 1) / ((known * share[:, None]).sum(0) + 2)

    def loss(table):
        total = 0.0
        for t in range(4):
            own = range(bounds[t], bounds[t + 1])
            x = {i: value[i] * trust[bucket[i]] for i in own}
            for h in range(2):
                rows = table[:, 3 * h : 3 * h + 3]
                z = np.log(rate[h] / (1 - rate[h])) + sum(rows[bucket[i], 0] * x[i] for i in own) + sum(rows[bucket[i], 1:] @ rows[bucket[j], 1:] * x[i] * x[j] for i in own for j in own if i < j)
                if known[t, h]:
                    total += share[t] * (np.log1p(np.exp(z)) - labels[t, h] * z) / 4
        return total

    got = Q.fit(bucket, value, bounds, labels, weights=weights).table / np.where(trust, trust, 1)[:, None]
    for b in np.unique(bucket):
        for c in range(6):
            e = np.zeros_like(start)
            e[b, c] = 1e-5
            g = (loss(start + e) - loss(start - e)) / 2e-5
            assert got[b, c] == pytest.approx(start[b, c] - Q.RATE * g / np.sqrt(1e-3 + g * g), abs=2e-4)
