"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE = 1 << 62  # ids from here on stand for null doc_ids between the steps of an operator, where h is odd

_written: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir. Where it is unset a session of one machine gets a folder of its own; on a
    cluster, whose executors would not see that, it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siftmark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> str:
    """Path of a Parquet table of df in the shared folder: lineage ends there, and a lost executor costs no
    recomputation of what led to it."""
    path = f"{shared_dir(df.sparkSession)}/siftmark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = df.sparkSession
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def tables() -> set[str]:
    """Paths of all tables that are there now."""
    return set(_written)


def discard(*paths: str) -> None:
    """Delete tables that nothing reads any longer."""
    for path in paths:
        spark = _written.pop(path, None)
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended already
            pass


def release() -> None:
    """Delete all tables; runs by itself when the program ends."""
    discard(*_written)


atexit.register(release)


def tuned(spark: SparkSession) -> SparkSession:
    """Fewer rows in an Arrow batch than the default, as texts are long, unless the session was made with a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000" and not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, "1000")
    return spark


def quoted(name: str) -> str:
    """A column's name as SQL takes it, with dots or not."""
    return "`" + name.replace("`", "``") + "`"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), which takes no names with dots; run finds columns by place."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of docs has one."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def identity(docs: DataFrame) -> list[Column]:
    """id and h, which tell the rows of docs apart but for those that are alike in doc_id and text, and text.

    id orders documents. h is 63 bits of doc_id and text and one that says whether doc_id is null; then id is NONE and
    62 bits of the text by another hash, so that null doc_ids come after all others below NONE.
    """
    own, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    other = F.shiftrightunsigned(F.xxhash64(F.lit(71), text), 2).bitwiseOR(F.lit(NONE))
    h = F.shiftleft(F.xxhash64(own, text), 1).bitwiseOR(own.isNull().cast("long"))
    return [F.coalesce(own, other).alias("id"), h.alias("h"), text.alias("text")]


def named(id: Column, h: Column) -> Column:
    """The doc_id that an id stands for."""
    return F.when(h.bitwiseAND(F.lit(1)) == 0, id)


def whole(batches: Iterator[pa.RecordBatch], *keys: str, rows: int = 100_000) -> Iterator[pa.Table]:
    """Tables of about `rows` sorted rows that don't cut a group of equal integer keys."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = changes(table, *keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n -= cut
        enough = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def changes(table: pa.Table, *keys: str) -> np.ndarray:
    """Where groups of equal keys begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        x = table[key].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
