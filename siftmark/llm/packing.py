"""Packing of documents into training sequences: first-fit decreasing in randomised groups.

Lengths are counted on executors and only (doc_id, length) rows are shuffled, never texts. Rows that are alike are
counted before they are drawn, so that copies of one row don't make a group of their own. Each group is packed by itself with a tournament tree over the free space of its bins, so a piece takes O(log bins) steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.llm.shared import tuned

CAPACITY, GROUP, SEED = 2048, 20_000, 7
TOGETHER = 1000  # so many copies of a row at most are drawn as one
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
SCHEMA = "group_id long, bin long, doc_id long, piece int, start long, length int, offset int"


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given: each goes to the first bin with room for it."""
    size = 1 << max(0, len(lengths) - 1).bit_length()
    tree = [capacity] * (2 * size)  # tree[i]: most free space of any bin below node i
    bins, offsets = [], []
    for n in lengths:
        i = 1
        while i < size:
            i *= 2
            if tree[i] < n:
                i += 1
        bins.append(i - size)
        offsets.append(capacity - tree[i])
        tree[i] -= n
        while i > 1:
            i >>= 1
            most = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == most:
                break
            tree[i] = most
    return bins, offsets


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Longest first; equal lengths by doc_id (null first), then piece."""
    rows = rows.loc[rows.index.repeat(rows["copies"])]
    ids = rows["doc_id"].astype("Int64")
    order = np.lexsort((rows["piece"].to_numpy(), ids.fillna(0).to_numpy(np.int64), ids.notna().to_numpy(), -rows["length"].to_numpy()))
    rows = rows.iloc[order].reset_index(drop=True)
    bins, offsets = first_fit(rows["length"].tolist(), capacity)
    return rows.assign(doc_id=rows["doc_id"].astype("Int64"), bin=bins, offset=offsets)[["group_id", "bin", "doc_id", "piece", "start", "length", "offset"]]


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, copies, doc_id, piece, start, length): a document of more than `capacity` tokens is cut into full pieces and a
    rest. copies rows are alike, and key is what they are drawn by."""
    text = docs["text"].cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"].cast("long"), text, F.lit(SEED)).alias("key"), F.regexp_count(text, F.lit(TOKEN)).alias("n")).where("n > 0")
    rows = rows.groupBy("key", "doc_id", "n").agg(F.count("*").alias("times")).select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / TOGETHER).cast("int"))).alias("part"))
    copies = F.least(F.lit(TOGETHER), F.col("times") - F.col("part") * TOGETHER).cast("int").alias("copies")
    rows = rows.select(F.when(F.col("part") == 0, F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), copies, "doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    return rows.select("key", "copies", "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(group_id, bin, doc_id, piece, start, length, offset): tokens start to start + length of a document lie at
    `offset` of a bin that holds at most `capacity`.

    A token is a word or a mark. Groups, of about `group` documents, are drawn by a hash of doc_id and text, so
    a rerun draws the same. Null, empty and blank texts have no tokens and are in no bin. Rows with a null
    doc_id are packed with it; repeated rows are each packed, up to TOGETHER of them in one group. Very long texts are cut
    into pieces. Other columns are not read; an empty table gives none.
    """
    tuned(docs.sparkSession)
    groups = max(1, -(-docs.count() // group))
    rows = pieces(docs, capacity).withColumn("group_id", F.pmod("key", F.lit(groups)))
    return rows.drop("key").groupBy("group_id").applyInPandas(lambda x: pack_group(x, capacity), SCHEMA)
