"""Command line: scan a tree, or parts of it, and report. Exits with 0 if nothing is found, 1 if something is, 2 on errors."""

from __future__ import annotations

import argparse
import os
import shutil
import stat
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from siftmark import report
from siftmark.functions.text import SEVERITIES
from siftmark.operators import dependencies, files, rules
from siftmark.plans import corpus, scans
from siftmark.sources import registries
from siftmark.sources.repofiles import read_repo

COMMANDS = {"scan": scans.full_scan, "check-deps": scans.scan_dependencies, "check-secrets": scans.scan_secrets, "check-rules": scans.scan_agent_rules, "check-docker": scans.scan_docker, "gate": scans.full_scan}
IGNORE_FILE, CACHE_DIR, MARKER = ".siftmarkignore", ".siftmark-cache", "SIFTMARK_CACHE"
HOOK = """#!/bin/sh
# Keeps commits back in which grave risks are found.
exec "${PYTHON:-python3}" -m siftmark.cli gate .
"""


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--severity", choices=SEVERITIES, default=None, help="least severity that is reported; INFO, for gate HIGH")
    shared.add_argument("--format", choices=("console", "json"), default="console")
    shared.add_argument("--no-color", action="store_true")
    shared.add_argument("--no-ignore", action="store_true")
    shared.add_argument("--registry", help="Parquet snapshot of package registries, to ask instead of them")
    shared.add_argument("--cache", help=f"directory of what was found of packages before; {CACHE_DIR} below the path")
    shared.add_argument("--offline", action="store_true", help="use the cache alone, however old")
    shared.add_argument("--as-of", help="time to count ages from; now")
    for name, url in registries.URLS.items():
        shared.add_argument(f"--{name.lower()}-url", default=url, help="where to ask for a package, {} in it")
    for kind in ("secret", "agent", "docker"):
        shared.add_argument(f"--{kind}-rules", help="JSON array of rules: name, pattern, severity, remediation")
    out = argparse.ArgumentParser(prog="siftmark", description=__doc__)
    out.add_argument("--version", action="version", version="siftmark 0.2")
    commands = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        commands.add_parser(name, parents=[shared]).add_argument("path", nargs="?", default=".")
    commands.add_parser("demo", parents=[shared])
    for name in ("cache-clear", "install-hook"):
        commands.add_parser(name).add_argument("path", nargs="?", default=".")
    return out


def clear_cache(path: str) -> bool:
    """Remove the cache that is the path or lies below it; only a directory that save_cache() made is one."""
    for at in (path, os.path.join(path, CACHE_DIR)):
        if os.path.isfile(os.path.join(at, MARKER)) and not os.path.islink(at):
            shutil.rmtree(at)
            return True
    return False


def save_cache(cache: DataFrame, path: str) -> None:
    """Write a new table beside the old one and put it in its place."""
    os.makedirs(path, exist_ok=True)
    open(os.path.join(path, MARKER), "a").close()
    new, old = os.path.join(path, "new"), os.path.join(path, "packages")
    cache.coalesce(1).write.mode("overwrite").parquet(f"file://{os.path.abspath(new)}")
    shutil.rmtree(old, ignore_errors=True)
    os.replace(new, old)


def install_hook(path: str) -> int:
    """Put HOOK in the place of a repository's pre-commit hook."""
    at = os.path.join(path, ".git", "hooks")
    if not os.path.isdir(os.path.dirname(at)):
        print(f"no repository: {path}", file=sys.stderr)
        return 2
    os.makedirs(at, exist_ok=True)
    name = os.path.join(at, "pre-commit")
    with open(name, "w", encoding="utf-8") as f:
        f.write(HOOK)
    os.chmod(name, os.stat(name).st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    return 0


def _table(given: argparse.Namespace, kind: str, usual: tuple[rules.Rule, ...]) -> tuple[rules.Rule, ...]:
    path = getattr(given, f"{kind}_rules")
    if path is None:
        return usual
    with open(path, encoding="utf-8") as f:
        return rules.rules_from_json(f.read())


def _known(spark: SparkSession, given: argparse.Namespace, tree: DataFrame, patterns: list[str], as_of: str) -> DataFrame | None:
    """What registry and cache say of the declared packages; the cache is brought up to date unless offline."""
    at = given.cache or os.path.join(given.path if os.path.isdir(given.path) else os.path.dirname(os.path.abspath(given.path)), CACHE_DIR)
    stored = os.path.join(at, "packages")
    have = os.path.isdir(stored) and os.path.isfile(os.path.join(at, MARKER))
    if given.offline and not have:
        print("packages are not checked: offline and no cache", file=sys.stderr)
        return None
    own = files.wanted(tree, patterns=patterns)
    packages = dependencies.from_requirements(own).unionByName(dependencies.from_package_json(own)).select("registry", "package").distinct()
    cache = dependencies.unbroken(spark.read.parquet(f"file://{os.path.abspath(stored)}")) if have else spark.createDataFrame([], dependencies.ANSWERS)
    snapshot = None
    if given.registry:
        snapshot = spark.read.parquet(given.registry)
    elif not given.offline:  # only what the cache doesn't say is asked for
        unknown = packages.join(dependencies.answers(packages, cache, None, as_of, False), ["registry", "package"], "left_anti")
        urls = {name: getattr(given, f"{name.lower()}_url") for name in registries.URLS}
        snapshot = dependencies.first_upload(registries.ask(unknown, urls)).where("http_status IS NOT NULL").cache()
    known = dependencies.answers(packages, cache, snapshot, as_of, given.offline).cache()
    if not given.offline and not known.isEmpty():
        save_cache(dependencies.sealed(dependencies.upsert(cache, known)), at)
    return known.drop("fetched_at")


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "cache-clear":
        print("cache removed" if clear_cache(given.path) else "there is no cache")
        return 0
    if given.command == "install-hook":
        return install_hook(given.path)
    if given.command != "demo" and not os.path.exists(given.path):
        print(f"no such path: {given.path}", file=sys.stderr)
        return 2
    try:
        as_of = given.as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        tables = {"secrets": _table(given, "secret", scans.ALL_SECRETS), "agent": _table(given, "agent", rules.AGENT), "docker": _table(given, "docker", rules.DOCKER)}
        severity = given.severity or ("HIGH" if given.command == "gate" else "INFO")
        spark = SparkSession.builder.appName("siftmark").getOrCreate()
        if given.command == "demo":
            print("A small made-up tree is scanned: a chat log, packages, rules of an agent and a container.\n", file=sys.stderr)
            how = scans.Scan(registry=corpus.registry(spark), as_of=given.as_of or corpus.AS_OF, severity=severity, **tables)
            found = scans.full_scan(corpus.demo(spark), how).cache()
        else:
            patterns: list[str] = []
            at = os.path.join(given.path, IGNORE_FILE)
            if not given.no_ignore and os.path.isfile(at):
                with open(at, encoding="utf-8") as f:
                    patterns = files.parse_ignore(f.read())
            tree = read_repo(spark, given.path, ignore="\n".join(patterns), with_data="false", prune=CACHE_DIR).select("file", "text")
            known = _known(spark, given, tree, patterns, as_of) if given.command in ("scan", "gate", "check-deps") else None
            how = scans.Scan(patterns=patterns, registry=known, as_of=as_of, single=os.path.isfile(given.path), severity=severity, **tables)
            found = COMMANDS[given.command](tree, how).cache()
        sys.stdout.writelines(report.json_parts(found) if given.format == "json" else report.console_parts(found, not given.no_color))
        code = 0 if given.command == "demo" else int(not found.isEmpty())
        if given.command == "gate":
            print("commit kept back: see above" if code else "no grave risk found", file=sys.stderr)
        return code
    except Exception as e:  # whatever goes wrong is an exit code for scripts
        print(f"failed: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
