"""A data source of the files below a directory, hidden ones too, which Spark's own file sources skip."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftmark.functions.text import glob_regex
from siftmark.operators.files import MOST_BYTES


def ignores(path: str, patterns: list[str]) -> bool:
    """As files.ignored, for one path: the first pattern that fits the path or its last part decides."""
    for p in patterns:
        body = p.removeprefix("!")
        fits = re.compile(glob_regex(body))
        if fits.match(path) or fits.match(path.rpartition("/")[2]) or body.endswith("/") and path.startswith(body):
            return not p.startswith("!")
    return False


class Listing(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RepoFiles(DataSource):
    """Options: path, a directory or a file; most_bytes; prune, names of directories not to enter, with commas between;
    ignore, patterns of an ignore file with line breaks between: directories that they ignore aren't entered, by the first
    pattern that fits; with_data, false to leave data null;
    per_task, so many files are read by a task. Rows are (file, length, text, data), file being relative to the path,
    in the order of names. Files over most_bytes and those that can't be read have a null text and data.
    text is UTF-8 without the bytes that aren't, its line breaks are \\n."""

    @classmethod
    def name(cls) -> str:
        return "repofiles"

    def schema(self) -> str:
        return "file string, length bigint, text string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return RepoReader(self.options)


class RepoReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.most = int(options.get("most_bytes", MOST_BYTES))
        self.prune = {p for p in options.get("prune", "").split(",") if p}
        self.per_task = int(options.get("per_task", 200))
        self.ignore = [p for p in options.get("ignore", "").split("\n") if p]
        self.with_data = options.get("with_data", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.root):
            return [Listing([self.root])]
        found = []
        for where, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.prune and not ignores(os.path.relpath(os.path.join(where, d), self.root).replace(os.sep, "/"), self.ignore))
            found += [os.path.join(where, n) for n in sorted(names)]
        return [Listing(found[k : k + self.per_task]) for k in range(0, len(found), self.per_task)] or [Listing([])]

    def read(self, partition: Listing) -> Iterator[tuple]:
        for path in partition.paths:
            name = os.path.basename(path) if path == self.root else os.path.relpath(path, self.root).replace(os.sep, "/")
            length = text = data = None
            try:
                root, real = os.path.realpath(self.root), os.path.realpath(path)
                inside = real == root or real.startswith(root.rstrip(os.sep) + os.sep)
                length = os.path.getsize(path)
                if inside and length <= self.most:
                    with open(path, "rb") as f:
                        data = f.read()
                    text = data.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
            except OSError:
                length = data = None
            yield name, length, text, data if self.with_data else None


def read_repo(spark: SparkSession, path: str, **options: str):
    """(file, length, text, data) of the files below path."""
    spark.dataSource.register(RepoFiles)
    return spark.read.format("repofiles").options(path=path, **options).load()
