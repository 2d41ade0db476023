"""Column functions on texts, lines and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where Python's splitlines() breaks.
BREAK = "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085\u2028\u2029]"
RARE_BREAK = BREAK[3:].replace("\n", "")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def split_lines(text: Column) -> Column:
    """Array of lines as splitlines() gives them: no empty one after a last break, none at all of an empty text."""
    parts = F.when(text.rlike(RARE_BREAK), F.split(text, BREAK, -1)).otherwise(F.split(text, "\n", -1))
    last = F.element_at(parts, -1) == ""
    return F.slice(parts, 1, F.size(parts) - last.cast("int"))


def explode_lines(files: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, with `line` from 1 and `line_text` instead of the text column. Null texts have none."""
    kept = [c for c in files.columns if c != text]
    rows = files.where(F.col(text).isNotNull()).select(*kept, F.posexplode(split_lines(F.col(text))).alias("_pos", "line_text"))
    return rows.select(*kept, (F.col("_pos") + 1).cast("int").alias("line"), "line_text")


def mask(value: Column) -> Column:
    """First and last four characters of a value of over eight, stars between; else four stars."""
    n = F.char_length(value)
    return F.when(n > 8, F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), n - 8), F.right(value, F.lit(4)))).otherwise("****")


def rank(severity: Column, unknown: int = 4) -> Column:
    """0 for CRITICAL to 4 for INFO, also where severity is null; `unknown` for other values."""
    out = F.when(severity.isNull(), 4)
    for k, name in enumerate(SEVERITIES):
        out = out.when(severity == name, k)
    return out.otherwise(unknown).cast("int")


def severity_of(ranked: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), ranked + 1)


MILD = r"(?i)example|sample|template|test|fixture|mock"
GRAVE = r"(?i)chat|conversation|\.log$|_log|ai[-_]output"


def shifted(ranked: Column, path: Column) -> Column:
    """One rank down for samples and tests, one up for chats and logs, none for both; stays within 0 to 4."""
    move = path.rlike(MILD).cast("int") - path.rlike(GRAVE).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(4), ranked + move)).cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """What comes before the last slash; empty where there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def glob_regex(glob: str) -> str:
    """Anchored regular expression for a shell pattern in which * also crosses slashes."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2)
        if c == "[" and end > 0:
            inside = glob[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside.replace("^", "\\^")) + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down also before zero."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("int")
