"""Blocks of lines between markers, by file: rows are (file, line, line_text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _up_to(last: int, *keys: str):
    return Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, last)


def extract(lines: DataFrame, start: str, end: str) -> DataFrame:
    """The first block with its markers; up to the end of the file where there is no end."""
    rows = lines.withColumn("_in", F.max(F.col("line_text") == start).over(_up_to(0, "file")))
    rows = rows.withColumn("_over", F.coalesce(F.max(F.col("_in") & (F.col("line_text") == end)).over(_up_to(-1, "file")), F.lit(False)))
    return rows.where("_in AND NOT _over").drop("_in", "_over")


def strip(lines: DataFrame, starts: list[str], end: str, managed: list[str]) -> DataFrame:
    """Without blocks: from a start marker on, blank and managed lines go until an end marker or another line. Markers go everywhere."""
    text = F.col("line_text")
    mark = F.when(text.isin(*starts), 1).when(text == end, 0)
    rows = lines.withColumns({"_mark": mark, "_part": F.count(mark).over(_up_to(0, "file"))})
    rows = rows.withColumn("_skip", F.last("_mark", ignorenulls=True).over(_up_to(0, "file")))
    foreign = F.col("_mark").isNull() & ~text.isin("", *managed)
    rows = rows.withColumn("_foreign", F.max(foreign).over(_up_to(0, "file", "_part")))
    return rows.where("_mark IS NULL AND (coalesce(_skip, 0) = 0 OR _foreign)").drop("_mark", "_part", "_skip", "_foreign")


def trim_end(lines: DataFrame) -> DataFrame:
    """Without the empty lines at the end of each file."""
    last = F.max(F.when(F.col("line_text") != "", F.col("line"))).over(Window.partitionBy("file"))
    return lines.withColumn("_last", last).where("line <= _last").drop("_last")


def append(lines: DataFrame, block: list[str]) -> DataFrame:
    """With an empty line, where there is anything before, and the block at the end of each file; lines are numbered anew."""
    own = lines.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("line"))).select("file", F.col("_n").alias("line"), "line_text")
    ends = own.groupBy("file").agg(F.max("line").alias("_last"))
    more = ends.select("file", "_last", F.posexplode(F.array(*map(F.lit, ["", *block]))).alias("_pos", "line_text"))
    return own.unionByName(more.select("file", (F.col("_last") + 1 + F.col("_pos")).cast("int").alias("line"), "line_text"))


def rewrite(lines: DataFrame, starts: list[str], end: str, managed: list[str], block: list[str]) -> DataFrame:
    """The block once, at the end; doing it again changes nothing. block begins with a start marker and closes with end.
    A file of which nothing is left keeps no line."""
    return append(trim_end(strip(lines, starts, end, [*managed, *block])), block)
