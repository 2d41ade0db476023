import random

import zstandard

from siftmark.llm import license as L

SCHEMA = "doc_id long, text string"


def scan(spark, rows, **more):
    return L.scan(spark.createDataFrame(rows, SCHEMA), **more).collect()


def test_every_wording_is_found_exactly(spark):
    rows = [(k, f"some words\n{t}\nother words") for k, t in enumerate(L.TEMPLATES.values())]
    got = {r.doc_id: r for r in scan(spark, rows)}
    for k, name in enumerate(L.TEMPLATES):
        assert (got[k].license, got[k].line, got[k].share, got[k].missing, got[k].extra) == (name, 1, 1.0, "", ""), name


def test_ranking_against_all_dictionaries():
    r = random.Random(1)
    ranker = L.Ranker(L.TEMPLATES)
    for name, t in L.TEMPLATES.items():
        words = L.wording(t)
        for _ in range(3):
            w = [r.choice(["foo", "bar"]) for _ in range(r.randint(0, 30))] + words + [r.choice(["foo", "bar"]) for _ in range(r.randint(0, 30))]
            block = " ".join(w)
            size, got = ranker.savings(block)
            assert size == len(zstandard.ZstdCompressor(level=L.LEVEL).compress(block.encode()))
            for gain, k in got:
                d = zstandard.ZstdCompressionDict(" ".join(ranker.words[k]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                assert gain == size - len(zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d).compress(block.encode()))
            assert [g for g, _ in got] == sorted((g for g, _ in got), reverse=True)
            assert ranker.found([block], L.LEAST_SHARE, L.MOST_RANKED)[0][0] == name


def test_differences_of_wording(spark):
    text = "Intro. Licensed under the ancient Apache License, Version 2.0. More\nno\nReleased under some license of ours"
    (r,) = scan(spark, [(1, text)])
    assert (r.license, r.line, r.missing, r.extra) == ("Apache-2.0", 0, "", "ancient") and r.saved > 0
    assert L.differences(["a", "b", "c"], ["x", "a", "q", "c", "y"]) == (2 / 3, ["b"], ["q"])


def test_two_licenses_in_a_row_and_versions(spark):
    rows = [(1, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (2, "This work is licensed under the GNU General Public License, version 2.")]
    assert sorted((r.doc_id, r.line, r.license) for r in scan(spark, rows)) == [(1, 0, "MIT"), (1, 1, "CC-BY-NC-4.0"), (2, 0, "GPL-2.0")]


def test_nulls_long_texts_repeats_and_nothing(spark):
    mit = L.TEMPLATES["MIT"]
    rows = [(None, mit), (1, mit), (1, mit), (2, None), (3, ""), (4, "license to nothing"), (5, "word " * 300_000 + "\n" + mit)]
    assert sorted((str(r.doc_id), r.line) for r in scan(spark, rows)) == [("1", 0), ("1", 0), ("5", 1), ("None", 0)]
    assert scan(spark, []) == []
    docs = spark.createDataFrame([(1, mit, 3, "x")], "doc_id long, text string, line int, license string")
    assert L.scan(docs).first().license == "MIT"


def test_license_inside_a_long_line(spark):
    r = random.Random(2)
    rows = []
    for k, t in enumerate(L.TEMPLATES.values()):
        w = [r.choice(["alpha", "beta", "gamma", "delta", "über"]) + str(r.randint(0, 5000)) for _ in range(3000)]
        rows.append((k, " ".join(w[:1500] + [t] + w[1500:])))
    got = scan(spark, rows)
    assert sorted((r.doc_id, r.license, r.missing, r.extra) for r in got) == [(k, name, "", "") for k, name in enumerate(L.TEMPLATES)]


def test_license_wrapped_over_lines(spark):
    for width in (3, 6, 10):
        rows = []
        for k, t in enumerate(L.TEMPLATES.values()):
            w = t.split()
            rows.append((k, "\n".join(["intro", *(" ".join(w[i : i + width]) for i in range(0, len(w), width)), "outro"])))
        got = scan(spark, rows)
        assert sorted((r.doc_id, r.license, r.line, r.missing, r.extra) for r in got) == [(k, name, 1, "", "") for k, name in enumerate(L.TEMPLATES)]


def test_all_licenses_of_a_block(spark):
    notice = L.TEMPLATES["MIT-permission"].split()
    isc = L.TEMPLATES["ISC"].split()
    rows = [
        (1, "Released under the MIT License. Licensed under CC BY 4.0."),
        (2, "\n".join([" ".join(notice[:12]), " ".join(notice[12:]), " ".join(isc[:9]), " ".join(isc[9:])])),
        (3, " ".join(L.TEMPLATES.values())),
    ]
    got = scan(spark, rows)
    assert sorted((r.doc_id, r.line, r.lines, r.license) for r in got if r.doc_id < 3) == [(1, 0, 1, "CC-BY-4.0"), (1, 0, 1, "MIT"), (2, 0, 2, "MIT-permission"), (2, 2, 2, "ISC")]
    assert sorted(r.license for r in got if r.doc_id == 3) == sorted(L.TEMPLATES)


def test_documents_of_one_id_are_told_apart(spark):
    w = L.TEMPLATES["BSD-redistribution"]
    a, b = w[:60], w[60:]
    docs = spark.createDataFrame([(None, a + "warranty \n" + b), (None, "x\n" + w), (7, a + "warranty \n" + b), (7, "x\n" + w)], SCHEMA).coalesce(1)
    assert sorted((str(r.doc_id), r.line, r.lines) for r in L.scan(docs).collect()) == [("7", 0, 2), ("7", 1, 1), ("None", 0, 2), ("None", 1, 1)]
