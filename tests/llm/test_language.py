import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftmark.llm import language
from siftmark.llm import text as T

SCHEMA = "doc_id long, text string, lang string"


def grams(text):
    ((_, points, bounds),) = T.codepoints(pa.array([text]))
    return Counter(int(b) for n in language.ORDERS for b in language.buckets(points, bounds, n) if b < 1 << language.BITS)


def test_posteriors_against_plain_counts(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chien et le chat", "fr"), (4, "another one in english", "en"), (5, None, "en"), (6, "kein", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    counts, seen = {}, Counter()
    for _, t, lang in rows:
        if t and lang:
            counts.setdefault(lang, Counter()).update(grams(t))
            seen[lang] += 1
    for i, t, _ in rows:
        if not t:
            assert not got[i].keep and got[i].lang is None and got[i].n_grams == 0
            continue
        score = {x: math.log(seen[x] / sum(seen.values())) + sum(n * math.log((c[b] + language.ALPHA) / (sum(c.values()) + language.ALPHA * 2**language.BITS)) for b, n in grams(t).items()) for x, c in counts.items()}
        best = max(score, key=score.get)
        score["?"] = -math.log(2**language.BITS) * sum(grams(t).values())
        if score[best] > score["?"]:
            assert got[i].lang == best and abs(got[i].confidence - 1 / sum(math.exp(v - score[best]) for v in score.values())) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = language.identify(docs.where(held), language.train(docs.where(~held))).withColumnRenamed("lang", "found").join(docs, "doc_id").collect()
    assert len(got) > 250 and np.mean([r.found == r.lang for r in got]) > 0.97 and np.mean([r.keep for r in got]) > 0.97


def test_rejects_what_is_in_no_known_language_and_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    odd = spark.createDataFrame([(1, "漢字仮名交文東京都知事選挙 " * 5, "x", 1), (2, "1234 5678 !!", "x", 1), (3, "", "x", 1), (None, None, "x", 1), (4, "the and of the tion and the", "x", 1), (4, "the and of the tion and the", "x", 1)], SCHEMA + ", _letters int")
    kept = language.keep(odd, model)
    assert kept.columns == odd.columns and [(r.doc_id, r.lang) for r in kept.collect()] == [(4, "en"), (4, "en")]
    assert language.keep(odd.where("false"), model).collect() == []
    nothing = language.train(odd.where("false"))
    assert {r.doc_id for r in language.keep(odd, nothing).collect()} == {1, 4}


def test_more_languages_than_a_table_holds(spark, monkeypatch):
    """300 labels: their posteriors are those of one table, and each text is told by words of its own."""
    rows = [(i, f"{chr(0x4E00 + i) * 9} the same words", "l%03d" % i) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs)
    ((_, points, bounds),) = T.codepoints(pa.array([t for _, t, _ in rows]))
    parts = model.scores(points, bounds)[0]
    assert len(list(model.tables())) == 5 and (parts.argmax(1) == np.arange(300)).mean() > 0.99
    monkeypatch.setattr(language, "TOGETHER", 1000)
    model.__dict__.pop("_kept")
    assert np.allclose(model.scores(points, bounds)[0], parts)


def test_a_long_text(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog " * 50_000, "en"), (2, "der hund und die katze", "de")], SCHEMA)
    assert {r.doc_id: r.lang for r in language.identify(docs, language.train(docs)).collect()} == {1: "en", 2: "de"}
