"""Reports of findings, for people and for programs. They are written piece by piece, as findings come from Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from siftmark.functions.text import SEVERITIES
from siftmark.operators import findings as fd

PAINT = {"CRITICAL": "\033[1;31m", "HIGH": "\033[31m", "MEDIUM": "\033[33m", "LOW": "\033[36m", "INFO": "\033[32m"}


def console_parts(df: DataFrame, colour: bool = False) -> Iterator[str]:
    """Blocks by severity, then the number of each severity that occurs."""
    paint = lambda text, s: f"{PAINT.get(s, '')}{text}\033[0m" if colour else text
    counts: dict[str, int] = {}
    for r in fd.titled(fd.ordered(df)).toLocalIterator():
        counts[r.severity or "INFO"] = counts.get(r.severity or "INFO", 0) + 1
        yield f"{paint(f'{r.severity or 'INFO':<10}', r.severity)} {r.title}\n  at {r.location}\n"
        yield from (f"  {label}{value}\n" for label, value in (("", r.message), ("found: ", r.value_preview), ("advice: ", r.remediation)) if value)
    yield " | ".join(f"{s}: {counts[s]}" for s in SEVERITIES if s in counts) + "\n" if counts else "Nothing found.\n"


def json_parts(df: DataFrame) -> Iterator[str]:
    """One array, non-ASCII escaped, indented by two."""
    before = "[\n"
    for r in fd.as_json(df.orderBy("check_ord", "file", "line", "rule_ord", "package")).toLocalIterator():
        yield before + "\n".join("  " + x for x in json.dumps(json.loads(r.finding), indent=2).split("\n"))
        before = ",\n"
    yield "[]\n" if before == "[\n" else "\n]\n"


def console(df: DataFrame, colour: bool = False) -> str:
    return "".join(console_parts(df, colour))


def as_json(df: DataFrame) -> str:
    return "".join(json_parts(df)).rstrip("\n")
