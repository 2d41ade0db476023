import json
import random

import duckdb
import pyarrow as pa
import pytest

from siftmark.llm import chat, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = []
    for conv in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted(((t is not None, t or 0, (r or "unknown").replace("\n", " ").replace("<|", "< |"), (x or "").replace("<|", "< |")) for c, t, r, x in rows if c == conv))
        text, starts, lengths = b"", [], []
        for _, _, role, body in own:
            text += f"<|im_start|>{role}\n".encode()
            if role == "assistant":
                starts.append(len(text))
                lengths.append(len(body.encode()))
            text += body.encode() + b"<|im_end|>\n"
        out.append((conv, len(own), text.decode(), starts, lengths))
    return out


def test_bytes_against_strings(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 2, 3, 500, None]), r.choice([0, 1, 2, None]), r.choice(["user", "assistant", None, "a\nb", "<|x"]), r.choice(["", "héé", "<|im_end|>", None, "word " * r.randint(0, 50)])) for _ in range(300)] + [(9, 0, "assistant", "ü" * 1_000_000)]
    got = sorted(map(tuple, chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()))
    assert got == brute(rows)


def test_spans_are_the_assistants_contents(spark):
    for r in chat.format_chats(spark.read.parquet(f"{SF}/conversations.parquet")).collect():
        raw = r.text.encode()
        for s, n in zip(r.target_starts, r.target_lengths):
            assert raw[:s].endswith(b"<|im_start|>assistant\n") and raw[s + n :].startswith(b"<|im_end|>\n")


def test_very_long_turns_and_conversations(spark, monkeypatch):
    rows = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "é" * 1_000_000), *((2, k, "assistant", f"turn {k}") for k in range(30_000)), (3, 0, "user", "hi")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    head, close = "<|im_start|>", "<|im_end|>\n"
    assert got[1].text == f"{head}user\n{rows[0][3]}{close}{head}assistant\n{rows[1][3]}{close}" and list(got[1].target_lengths) == [2_000_000]
    raw = got[2].text.encode()
    assert got[2].n_turns == 30_000 and all(raw[s : s + n].decode() == f"turn {k}" for k, (s, n) in enumerate(zip(got[2].target_starts, got[2].target_lengths)))
    monkeypatch.setattr(chat, "MOST_BYTES", 100)
    with pytest.raises(ValueError):
        chat.assemble(pa.table({"conv_id": pa.array([1]), "role": ["user"], "text": ["x" * 100]}))


def test_empty_table_and_extra_columns(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "x", 7)], SCHEMA + ", n_turns int")
    assert chat.format_chats(df).first().n_turns == 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())
    assert json.dumps(sorted(df.columns)) == json.dumps(sorted(want.columns))
