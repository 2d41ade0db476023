"""The scans, each from files (file, text) to findings."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import split_lines
from siftmark.operators import ast_strings, dependencies, files, findings, rules

ALL_SECRETS = rules.SECRETS + rules.PERSONAL


@dataclass(frozen=True)
class Scan:
    """What all scans take. patterns: of an ignore file; registry: a snapshot of the packages' registries, without which
    packages give no findings, and as_of, the time to count their age from; single: a file is given, not a tree;
    severity: the least that is asked for, so that rules below it are never matched; the tables of rules."""

    patterns: Iterable[str] = ()
    registry: DataFrame | None = None
    as_of: str = "2026-01-01 00:00:00"
    single: bool = False
    severity: str = "INFO"
    secrets: tuple[rules.Rule, ...] = ALL_SECRETS
    agent: tuple[rules.Rule, ...] = rules.AGENT
    docker: tuple[rules.Rule, ...] = rules.DOCKER

    def some(self, table: tuple[rules.Rule, ...]) -> tuple[rules.Rule, ...]:
        return rules.at_least(table, self.severity)


def scan_dependencies(tree: DataFrame, how: Scan = Scan()) -> DataFrame:
    """Risks of the packages that requirements.txt and package.json declare."""
    own = files.wanted(tree, patterns=list(how.patterns))
    packages = dependencies.from_requirements(own).unionByName(dependencies.from_package_json(own))
    return findings.at_least(dependencies.check(packages, _registry(tree, how), how.as_of), how.severity)


def _registry(tree: DataFrame, how: Scan) -> DataFrame:
    return tree.sparkSession.createDataFrame([], dependencies.REGISTRY) if how.registry is None else how.registry


def scan_secrets(tree: DataFrame, how: Scan = Scan()) -> DataFrame:
    """Secrets and personal data in the lines of text files, and in the strings of Python files."""
    own, table = files.wanted(tree.where(files.is_text(F.col("file"))), patterns=list(how.patterns)), how.some(how.secrets)
    return findings.union(findings.secret_findings(rules.match_files(own, table)), ast_strings.ast_secrets(own, table))


def scan_agent_rules(tree: DataFrame, how: Scan = Scan()) -> DataFrame:
    """Dangerous instructions in the Markdown of agents; single takes any file."""
    own = files.wanted(tree if how.single else tree.where(files.is_agent_rules(F.col("file"))), patterns=list(how.patterns))
    found = rules.match_files(own, how.some(how.agent))
    return findings.findings(found, "agent_rule", file="file", line="line", rule_ord="rule_ord", rule_name="rule_name", severity="severity", matched_content="matched", remediation="advice")


def scan_docker(tree: DataFrame, how: Scan = Scan()) -> DataFrame:
    """Risky settings of containers; single takes any file."""
    own = files.wanted(tree if how.single else tree.where(files.is_docker(F.col("file"))), patterns=list(how.patterns))
    found = rules.match_files(own, how.some(how.docker))
    return findings.findings(found, "docker", file="file", line="line", rule_ord="rule_ord", rule_name="rule_name", severity="severity", message="advice")


_HIT = "struct<check_ord:int,rule_ord:int,rule_name:string,severity:string,advice:string,matched:string>"


def full_scan(tree: DataFrame, how: Scan = Scan()) -> DataFrame:
    """All four, repeated findings included, in one pass over the files.

    A file becomes entries: its lines, where some rule that its place asks for may match in it, or where it declares
    packages; its strings, if it is Python; its keys, if it is a package.json. An entry becomes hits of all rules of its
    file, and what packages are known for is joined to these few.
    """
    secrets, agent, docker = (how.some(t) for t in (how.secrets, how.agent, how.docker))
    path, text = F.col("file"), F.col("text")
    own = files.wanted(tree, patterns=list(how.patterns))
    place = {"_text": files.is_text(path), "_agent": F.lit(True) if how.single else files.is_agent_rules(path), "_docker": F.lit(True) if how.single else files.is_docker(path), "_req": dependencies.is_requirements(path)}
    own = own.select("file", "text", *(c.alias(k) for k, c in place.items()))
    tables = {"_text": secrets, "_agent": agent, "_docker": docker}
    ask = F.col("_req")
    for k, table in tables.items():
        ask = ask | (F.col(k) & rules.any_of(text, table, rules.in_text))
    none = lambda kind: F.array().cast(kind)
    lines = F.when(ask, F.transform(split_lines(text), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("value"), F.lit(0).alias("kind"))))
    keys = F.when(dependencies.is_package_json(path), F.transform(dependencies.declared(text), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("value"), F.lit(3).alias("kind"))))
    parsed = ast_strings.strings_of(F.when(ast_strings.is_python(path), text))
    told = F.transform(F.coalesce(parsed, none(ast_strings.SHAPE)), lambda x: F.struct(x["line"].alias("line"), x["value"].alias("value"), F.when(x["is_concat"], 2).otherwise(1).alias("kind")))
    kind = "array<struct<line:int,value:string,kind:int>>"
    entries = F.explode(F.concat(F.coalesce(lines, none(kind)), F.coalesce(keys, none(kind)), told.cast(kind)))
    own = own.select("file", *place, entries.alias("_e")).select("file", *place, "_e.*")
    is_line, is_string = F.col("kind") == 0, F.col("kind").isin(1, 2)
    wants = {"secret": F.col("_text") & (is_line | is_string), "agent_rule": F.col("_agent") & is_line, "docker": F.col("_docker") & is_line}
    value = F.col("value")
    parts = []
    for check, table in zip(wants, tables.values()):
        number = F.lit(findings.CHECKS.index(check)).alias("check_ord")
        parts.append(F.when(wants[check], rules.hits(value, table, number)).otherwise(none(f"array<{_HIT}>")) if table else none(f"array<{_HIT}>"))
    package = F.when(F.col("_req") & is_line, dependencies.required(value)).when(F.col("kind") == 3, value).otherwise("")
    null = F.lit(None).cast("string")
    declared = F.struct(F.lit(0).alias("check_ord"), F.col("line").alias("rule_ord"), package.alias("rule_name"), null.alias("severity"), null.alias("advice"), F.when(F.col("kind") == 3, dependencies.NPM).otherwise(dependencies.PYPI).alias("matched"))
    parts.append(F.when((package != "") | (F.col("kind") == 3), F.array(declared)).otherwise(none(f"array<{_HIT}>")))
    found = own.select("file", "line", "kind", F.explode(F.concat(*(p.cast(f"array<{_HIT}>") for p in parts))).alias("_h")).select("file", "line", "kind", "_h.*")
    return findings.at_least(_shaped(found, _registry(tree, how), how), how.severity)


def _shaped(found: DataFrame, registry: DataFrame, how: Scan) -> DataFrame:
    """Hits as findings. Those that aren't packages have keys of their own, so a join by shuffle spreads them."""
    dep, secret, agent, docker = (F.col("check_ord") == k for k in range(4))
    found = found.withColumns({"registry": F.when(dep, F.col("matched")).otherwise(F.concat(F.lit("\0"), F.col("file"))), "package": F.when(dep, F.col("rule_name")).otherwise("")})
    known = found.join(registry, ["registry", "package"], "left").withColumn("_risk", F.when(dep, dependencies.risk(F.col("http_status"), F.col("created_at"), how.as_of)))
    known = known.where(~dep | F.col("_risk").isNotNull())
    name = F.concat("rule_name", F.when(F.col("kind") == 2, " (AST Concat)").otherwise(""))
    only = lambda when, c: F.when(when, F.col(c) if isinstance(c, str) else c)
    names = F.element_at(F.array(*map(F.lit, findings.CHECKS)), F.col("check_ord") + 1)
    return findings.findings(
        known, "", check=names, check_ord="check_ord", file=only(~dep, "file"), line=only(~dep, "line"), rule_ord="rule_ord", pattern_name=only(secret, name), rule_name=only(agent | docker, "rule_name"), package=only(dep, "package"), registry=only(dep, "registry"),
        severity=F.when(dep, F.col("_risk.severity")).otherwise(F.col("severity")), message=F.when(dep, F.col("_risk.message")).when(docker, F.col("advice")), value_preview=only(secret, findings.mask(F.col("matched"))), matched_content=only(agent, "matched"), remediation=only(agent, "advice"),
    )
