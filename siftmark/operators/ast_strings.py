"""Strings of Python sources: constants, and sums of constants folded."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.operators.findings import secret_findings
from siftmark.operators.rules import Rule, match_values

DEEPEST = 100


def _folded(top: ast.AST) -> tuple[str | None, list[ast.AST]]:
    """Value and nodes of a sum of string constants; (None, []) where another operand is in it. Raises OverflowError
    below DEEPEST. Left operands come first, without recursion."""
    todo, nodes, parts = [(top, 0)], [], []
    known = True
    while todo:
        node, depth = todo.pop()
        if depth > DEEPEST:
            raise OverflowError
        nodes.append(node)
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            parts.append(node.value)
        elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            todo += [(node.right, depth + 1), (node.left, depth + 1)]
        else:
            known = False
    return ("".join(parts), nodes) if known else (None, [])


def strings(source: str) -> list[tuple[int, str, bool]]:
    """(line, value, whether it was a sum) in breadth-first order. Sources that Python can't parse have none. A sum too
    deep to fold is left to the smaller sums in it; what a folded sum holds isn't given again."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, OverflowError, RecursionError, MemoryError):
        return []
    out, done = [], set()
    for node in ast.walk(tree):
        if id(node) in done:
            continue
        line = getattr(node, "lineno", 1)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            try:
                value, nodes = _folded(node)
            except OverflowError:
                continue
            if value:
                done.update(map(id, nodes))
                out.append((line, value, True))
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            out.append((line, node.value, False))
    return out


SHAPE = "array<struct<line:int,value:string,is_concat:boolean>>"


def strings_of(source: Column) -> Column:
    """The strings of a source; null for a null."""

    def tell(text: str) -> list[dict]:  # what UTF-8 can't hold is dropped, as it can't be in a secret
        return [{"line": n, "value": v.encode("utf-8", "ignore").decode(), "is_concat": c} for n, v, c in strings(text)]

    def each(sources: pd.Series) -> pd.Series:
        return sources.map(tell, na_action="ignore")

    return F.pandas_udf(each, SHAPE)(source)


def is_python(path: Column) -> Column:
    return path.endswith(".py")


def ast_strings(files: DataFrame) -> DataFrame:
    """(file, line, value, is_concat) of the files named *.py. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *s) for f, t in zip(*(c.to_pylist() for c in batch.columns)) for s in strings(t)]
            if rows:
                # what UTF-8 can't hold is dropped, as it can't be in a secret
                clean = [v.encode("utf-8", "ignore").decode() for _, _, v, _ in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(clean, pa.string()), pa.array([r[3] for r in rows], pa.bool_())], ["file", "line", "value", "is_concat"])

    rows = files.where(is_python(F.col("file")) & F.col("text").isNotNull()).select("file", "text")
    return rows.mapInArrow(run, "file string, line int, value string, is_concat boolean")


def ast_secrets(files: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in the strings of Python files; the name of the pattern tells where a sum was folded."""
    found = match_values(ast_strings(files), "value", rules)
    return secret_findings(found.withColumn("rule_name", F.when(F.col("is_concat"), F.concat("rule_name", F.lit(" (AST Concat)"))).otherwise(F.col("rule_name"))))
