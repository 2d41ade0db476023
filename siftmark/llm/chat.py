"""Chat formatting by columnar byte assembly.

Turns are brought together by conversation and sorted; from then on no string is built in Python. Lengths of the
segments give offsets by a cumulative sum, and constants, roles and contents are scattered into one buffer that
becomes the Arrow column as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm import text as T
from siftmark.llm.shared import tuned

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TARGET = "assistant"
MOST_BYTES = (1 << 31) - 1
SCHEMA = "conv_id long, n_turns int, text string, target_starts array<int>, target_lengths array<int>"


def _scatter(out: np.ndarray, at: np.ndarray, column: pa.Array, lengths: np.ndarray) -> None:
    """Copy every string of column to its place in out."""
    data, offsets = T._buffer(column)
    out[np.repeat(at - offsets[:-1], lengths) + np.arange(len(data))] = data


def _constant(out: np.ndarray, at: np.ndarray, what: str) -> None:
    raw = np.frombuffer(what.encode(), np.uint8)
    out[at[:, None] + np.arange(len(raw))] = raw


def assemble(rows: pa.Table) -> pa.RecordBatch:
    """Whole conversations, sorted, with columns conv_id, role, text and none of them null."""
    ids = rows["conv_id"].combine_chunks()
    role, content = (rows[c].combine_chunks() for c in ("role", "text"))
    ids, role, content = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, role, content))
    key = ids.to_numpy(zero_copy_only=False)
    roles, contents = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (role, content))
    sizes = len(OPEN) + roles + len(BREAK) + contents + len(CLOSE)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(at[-1], np.uint8)
    _constant(out, at[:-1], OPEN)
    _scatter(out, at[:-1] + len(OPEN), role, roles)
    _constant(out, at[:-1] + len(OPEN) + roles, BREAK)
    body = at[:-1] + len(OPEN) + roles + len(BREAK)
    _scatter(out, body, content, contents)
    _constant(out, at[1:] - len(CLOSE), CLOSE)
    first = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(key)).astype(np.int64)
    offsets = np.append(at[first], at[-1])
    if np.diff(offsets).max(initial=0) > MOST_BYTES:
        raise ValueError(f"a conversation of more than {MOST_BYTES} bytes doesn't fit a string column")
    texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))
    target = np.flatnonzero(pc.equal(role, TARGET).to_numpy(zero_copy_only=False))
    conv = np.searchsorted(first, target, "right") - 1
    bounds = pa.array(np.searchsorted(conv, np.arange(len(first) + 1)).astype(np.int32))
    starts = pa.ListArray.from_arrays(bounds, pa.array((body[target] - at[first][conv]).astype(np.int32)))
    lengths = pa.ListArray.from_arrays(bounds, pa.array(contents[target].astype(np.int32)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array((ends - first).astype(np.int32)), texts, starts, lengths], ["conv_id", "n_turns", "text", "target_starts", "target_lengths"])


def _whole(batches: Iterator[pa.RecordBatch], most: int = 64_000_000) -> Iterator[pa.Table]:
    """Tables of whole conversations of about `most` bytes at the utmost, or of one longer conversation."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = T.column_of(batch, "conv_id").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if waiting and T.column_of(waiting[-1], "conv_id")[-1].as_py() != key[0]:
            cuts = np.concatenate(([0], cuts))
        done = 0
        size = np.cumsum(pc.binary_length(T.column_of(batch, "text")).to_numpy(zero_copy_only=False).astype(np.int64))
        for k, cut in enumerate(cuts):
            last = k == len(cuts) - 1
            if last or cut and size[cuts[k + 1] - 1] - (size[done - 1] if done else 0) > most:
                yield pa.Table.from_batches([*waiting, batch.slice(done, cut - done)])
                waiting, done = [], cut
        waiting.append(batch.slice(done))
    if waiting:
        yield pa.Table.from_batches(waiting)


def format_chats(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its turns in order as one text, and the byte spans of the assistant's contents.

    Turns sort by turn (null first), then role, then text, so ties and repeated rows have a fixed place; repeated
    rows are all kept. A null role becomes "unknown", a null text an empty one. Line breaks in a role become
    spaces and "<|" in a role or text becomes "< |", so that no content passes for a header. Turns with a null
    conv_id belong to no conversation and are left out. Very long turns are taken whole; a conversation of over 2 GiB,
    which no string can hold, is an error. Other columns are not read; an empty table gives none.
    """
    tuned(turns.sparkSession)
    tame = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"),
        tame(F.translate(F.coalesce(turns["role"].cast("string"), F.lit("unknown")), "\n", " ")).alias("role"), tame(F.coalesce(turns["text"].cast("string"), F.lit(""))).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            yield assemble(table)

    return ordered.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), chr(10), ' '), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
o AS (SELECT *, strlen(head) + coalesce(sum(strlen(head) + strlen(text) + 11) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS body FROM s)
SELECT conv_id, count(*)::INT AS n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
  coalesce('[' || string_agg(body::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (role = 'assistant') || ']', '[]') AS target_starts,
  coalesce('[' || string_agg(strlen(text)::VARCHAR, ',' ORDER BY k) FILTER (role = 'assistant') || ']', '[]') AS target_lengths
FROM o GROUP BY conv_id"""
