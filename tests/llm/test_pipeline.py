import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftmark.llm import decontaminate, jaccard, language, packing, suffixes

from .test_jaccard import brute as near_pairs
from .test_jaccard import groups_by_pairs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[0-9a-z_\x80-\U0010FFFF]+")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "suffix_array", "decontamination", "packing"]


def cut(rows, length=suffixes.LENGTH):
    """Texts without words in windows seen before, by brute force."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = list(WORD.finditer(text.lower()))
        gone = set()
        for p in range(len(words) - length + 1):
            g = tuple(m[0] for m in words[p : p + length])
            if g in seen:
                gone |= set(range(p, p + length))
            seen.add(g)
        rest, at, k = "", 0, 0
        while k < len(words):
            if k in gone:
                rest += text[at : words[k].start()]
                while k + 1 in gone:
                    k += 1
                at = words[k].end()
            k += 1
        if len(gone) < len(words) or not words:
            out[i] = rest + text[at:]
    return out


def ngrams(text):
    """Buckets of the n-grams of a text, one by one."""
    points, mask = [ord(c) for c in text.lower()], 2**32 - 1
    for n in language.ORDERS:
        for k in range(len(points) - n + 1):
            h = n
            for c in points[k : k + n]:
                h = (((h * 0x01000193) & mask) ^ c) * 0x9E3779B1 & mask
            h ^= h >> 15
            yield (h * 0x85EBCA77 & mask) >> (32 - language.BITS)


def known_languages(rows):
    """{doc_id: language} of the documents that are kept, by naive Bayes on dictionaries."""
    counts, seen = {}, Counter()
    grams = {r.doc_id: Counter(ngrams(r.text or "")) for r in rows}
    for r in rows:
        if r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(grams[r.doc_id])
            seen[r.lang] += 1
    size = 2**language.BITS
    total = {x: math.log(sum(c.values()) + language.ALPHA * size) for x, c in counts.items()}
    out = {}
    for r in rows:
        own = grams[r.doc_id]
        score = {x: math.log(seen[x] / sum(seen.values())) + sum(n * (math.log(c[b] + language.ALPHA) - total[x]) for b, n in own.items()) for x, c in counts.items()}
        best = max(sorted(score), key=score.get)
        score[None] = -math.log(size) * sum(own.values())
        most = max(score.values())
        if re.search(r"[^\W\d_]", r.text or "") and score[best] == most and 1 / sum(math.exp(v - most) for v in score.values()) >= language.LEAST_CONFIDENCE:
            out[r.doc_id] = best
    return out


def leaky(text, tests, n=decontaminate.N, share=decontaminate.SHARE, slack=decontaminate.SLACK):
    """Whether a text holds a phrase of a test, or most of its words close together."""
    w = WORD.findall(text.lower())
    have, runs = set(w), {tuple(w[k : k + n]) for k in range(len(w))}
    for test in tests:
        q = WORD.findall((test or "").lower())
        if not q:
            continue
        size, terms = min(n, len(q)), set(q)
        if any(tuple(q[k : k + size]) in (runs if size == n else {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}) for k in range(len(q) - size + 1)):
            return True
        least, span = math.ceil(share * len(terms) - 1e-9), math.ceil(slack * len(q) - 1e-9)
        if len(terms & have) >= least and any(len(terms & set(w[k : k + span])) >= least for k in range(len(w))):
            return True
    return False


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    texts = {n: {r.doc_id: r.text for r in d.collect()} for n, d in kept.items() if n != "packing"}

    raw = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert {r.doc_id: r.lang for r in kept["language_id"].collect()} == known_languages(raw) and len(texts["language_id"]) > 150

    groups = groups_by_pairs(near_pairs(texts["language_id"].items()))
    gone = {x for g in groups for x in g[1:]}
    extra = set(texts["ngram_jaccard"]) & gone
    assert set(texts["ngram_jaccard"]) - extra == set(texts["language_id"]) - gone and len(extra) <= 0.1 * len(gone)

    assert texts["suffix_array"] == cut(texts["ngram_jaccard"].items())

    tests = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in texts["suffix_array"].items() if leaky(t, tests)}
    assert leaks and set(texts["decontamination"]) == set(texts["suffix_array"]) - leaks

    rows = kept["packing"].collect()
    token = re.compile(r"[^\W]+|[^\s\w]")
    tokens = {i: len(token.findall(t)) for i, t in texts["decontamination"].items()}
    cut_up = sorted((i, k, s, min(packing.CAPACITY, n - s)) for i, n in tokens.items() for k, s in enumerate(range(0, n, packing.CAPACITY)))
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == cut_up
    for g in {r.group_id for r in rows}:
        own = sorted((r for r in rows if r.group_id == g), key=lambda r: (-r.length, r.doc_id, r.piece))
        free = []
        for r in own:
            b = next((k for k, room in enumerate(free) if room >= r.length), len(free))
            free += [packing.CAPACITY] * (b == len(free))
            assert (r.bin, r.offset) == (b, packing.CAPACITY - free[b])
            free[b] -= r.length


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and set(rows[0].asDict()) == {"group_id", "bin", "doc_id", "piece", "start", "length", "offset"}


def test_removal_of_cased_and_marked_text(spark):
    base = " ".join(f"Wörd{i}," for i in range(12))
    rows = [(1, f"İntro KELVIN. {base} End!"), (2, f"Other start -- {base.upper()} OTHER end?"), (3, base.lower()), (None, base), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_chars long, pos string")
    got = sorted(((r.doc_id, r.text) for r in suffixes.remove(docs, 10, 3).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, "Other start -- , OTHER end?"), (4, None), (5, ""), (5, "")], key=str)
    assert suffixes.remove(docs.where("false"), 10, 3).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_empty_null_and_clashing_input(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, h int, keep string, `meta.url` string, _id int, _h int, _letters int"
    empty = spark.createDataFrame([], schema)
    assert stage(spark, empty, SF).collect() == []
    rest = (1, 1, "k", "u", 1, 1, 1)
    rows = [(None, None, None, None, None, *rest), (1, "", "en", "s", 0, *rest), (1, "the same words here", "en", "s", 19, *rest), (1, "the same words here", "en", "s", 19, *rest), (2, "long " * 200_000, "en", "s", 10**6, *rest)]
    out = stage(spark, spark.createDataFrame(rows, schema), SF)
    assert out.columns == packing_columns() if stage is corpus_pipeline.packed else out.columns == empty.columns
    out.collect()


def packing_columns():
    return [c.split()[0] for c in packing.SCHEMA.split(", ")]
