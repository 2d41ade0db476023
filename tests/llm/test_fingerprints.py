import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siftmark.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def brute(text, k, window):
    kept = [(p, ord(ch)) for p, ch in enumerate(text.lower()) if re.fullmatch(r"[0-9a-z_\x80-\U0010FFFF]", ch)]
    hashes = []
    for i in range(len(kept) - k + 1):
        own = []
        for p in fp.PRIMES:
            h = 0
            for _, x in kept[i : i + k]:
                h = (h * fp.BASE + x) % p
            own.append(h)
        hashes.append(tuple(own))
    chosen = set()
    for i in range(max(1, len(hashes) - window + 1)) if hashes else ():
        part = hashes[i : i + window]
        chosen.add(i + max(j for j, h in enumerate(part) if h[0] == min(part)[0]))
    return [(kept[i][0], hashes[i][0] * 2**31 + hashes[i][1]) for i in sorted(chosen)]


def test_rows_against_brute_force(spark):
    texts = ["The quick brown fox, jumps!  over the lazy dog", "a" * 60, "é" * 9, "ab" * 40, "", None, "abc", "Ünï cödé " * 20, "x1 y2 " * 30_000]
    rows = list(enumerate(texts)) + [(None, texts[0]), (0, texts[0])]
    for k, window in ((4, 5), (8, 1), (3, 40)):
        got = fp.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(2), k, window).collect()
        want = [(i, *x) for i, t in rows for x in brute(t or "", k, window)]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@settings(max_examples=100, deadline=None)
@given(st.text("ab", min_size=14, max_size=30), st.text("abc", max_size=20), st.text("abc", max_size=20), st.text("abc", max_size=20))
def test_match_guarantee(shared, before, other, after):
    a, b = before + shared + other, after + shared
    assert {h for _, h in brute(a, 6, 9)} & {h for _, h in brute(b, 6, 9)}


def test_empty_table_and_clashing_columns(spark):
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(1, "abcdefgh" * 9, 5)], SCHEMA + ", pos int")
    assert fp.fingerprints(docs).count() > 0
