"""Findings of all checks in one shape: union, filter, order, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import SEVERITIES, mask, rank

SCHEMA = "check string, check_ord int, file string, line int, rule_ord int, pattern_name string, rule_name string, package string, registry string, severity string, message string, value_preview string, matched_content string, remediation string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
CHECKS = ("dependency", "secret", "agent_rule", "docker")


def findings(df: DataFrame, check: str, /, **columns: Column | str) -> DataFrame:
    """df in the shape of findings; columns say what the fields are, others are null. Without a name for all, check and
    check_ord are among the columns."""
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    given = ({"check": F.lit(check), "check_ord": F.lit(CHECKS.index(check))} if check else {}) | columns
    value = lambda c: F.col(given[c]) if isinstance(given[c], str) else given[c]
    return df.select(*((value(c) if c in given else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS))


def secret_findings(matches: DataFrame, suffix: str = "") -> DataFrame:
    """Of matches with file and line."""
    return findings(matches, "secret", file="file", line="line", rule_ord="rule_ord", pattern_name=F.concat("rule_name", F.lit(suffix)), severity="severity", value_preview=mask(F.col("matched")))


def union(*parts: DataFrame) -> DataFrame:
    """All findings, repeated ones too."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def at_least(df: DataFrame, severity: str) -> DataFrame:
    """Findings as grave as `severity` or more; an unknown one counts as INFO, on both sides."""
    most = SEVERITIES.index(severity) if severity in SEVERITIES else 4
    return df.where(rank(F.col("severity")) <= most)


def ordered(df: DataFrame) -> DataFrame:
    """The gravest first, severities that are unknown last, then by check, file, line and rule."""
    return df.orderBy(rank(F.col("severity"), 5), "check_ord", "file", "line", "rule_ord", "package")


def histogram(df: DataFrame) -> DataFrame:
    """(severity, n) for the severities that occur; null counts as INFO."""
    return df.groupBy(F.coalesce("severity", F.lit("INFO")).alias("severity")).agg(F.count("*").alias("n"))


def titled(df: DataFrame) -> DataFrame:
    """With title, the first name that isn't empty, and location: file:line, the file alone, or N/A."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    title = F.coalesce(some("pattern_name"), some("rule_name"), some("package"), F.lit("Issue"))
    where = F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.coalesce("file", F.lit("None")), F.lit(":"), F.col("line").cast("string"))).otherwise(F.coalesce("file", F.lit("N/A")))
    return df.withColumns({"title": title, "location": where})


def lines(df: DataFrame) -> DataFrame:
    """(severity, headline, location): the severity to a width of ten before the title."""
    return titled(df).select("severity", F.concat(F.rpad(F.coalesce("severity", F.lit("INFO")), 10, " "), F.lit(" "), "title").alias("headline"), "location")


def as_json(df: DataFrame) -> DataFrame:
    """A JSON object for each finding; fields that are null are left out."""
    return df.select(F.to_json(F.struct(*(c for c in df.columns if c not in ("check_ord", "rule_ord")))).alias("finding"))


def exit_code(df: DataFrame) -> DataFrame:
    """One row: 1 if there is a finding, else 0. Only one row of df is looked for."""
    return df.limit(1).agg(F.when(F.count("*") > 0, 1).otherwise(0).cast("int").alias("exit_code"))
