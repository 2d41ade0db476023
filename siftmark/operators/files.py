"""Which files a check looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.functions.text import base_name, directory, explode_lines, glob_regex

MOST_BYTES = 10 * 1024 * 1024
TEXT_SUFFIXES = ("bash", "js", "json", "log", "md", "ps1", "py", "sh", "ts", "txt", "yaml", "yml")
AGENT_PLACES = (".cursor", ".agent", ".github/copilot")  # .agents holds .agent


def inside(path: Column, root: str) -> Column:
    """Below the root; a neighbour whose name begins alike is not, nor is what climbs out with `..`."""
    return path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def small_enough(length: Column) -> Column:
    return length <= MOST_BYTES


def is_text(path: Column) -> Column:
    return path.rlike(r"\.(" + "|".join(TEXT_SUFFIXES) + ")$")


def is_docker(path: Column) -> Column:
    name = base_name(path)
    return name.contains("Dockerfile") | name.contains("docker-compose")


def is_agent_rules(path: Column) -> Column:
    """Markdown below a place of agents."""
    where = directory(path)
    return path.endswith(".md") & where.rlike("|".join(p.replace(".", r"\.") for p in AGENT_PLACES))


def parse_ignore(text: str) -> list[str]:
    """Patterns of an ignore file in order, without blank lines and comments."""
    return [p for p in map(str.strip, text.splitlines()) if p and not p.startswith("#")]


def ignore_patterns(files: DataFrame, name: str) -> DataFrame:
    """(file, ord, pattern) of the ignore files of a name: their lines, trimmed, without blank ones and comments."""
    lines = explode_lines(files.where(base_name(F.col("file")) == name).select("file", "text"))
    return lines.select("file", F.col("line").alias("ord"), F.regexp_replace("line_text", r"(?U)^\s+|\s+$", "").alias("pattern")).where("pattern <> '' AND NOT startswith(pattern, '#')")


def ignored(path: Column, patterns: list[str], mode: str = "compat") -> Column:
    """Whether a path is ignored. compat: the first pattern that fits decides, on the whole path, its last part, or a
    directory with a slash at its end that the path begins with. gitignore: the last that fits decides, a name without a
    slash fits at any depth, and what is below an ignored directory is ignored."""
    path = F.regexp_replace(path, r"^\./", "")
    out = None
    for pattern in patterns if mode == "compat" else reversed(patterns):
        negate = pattern.startswith("!")
        p = pattern.removeprefix("!")
        if mode == "compat":
            fits = path.rlike(glob_regex(p)) | base_name(path).rlike(glob_regex(p))
            if p.endswith("/"):
                fits = fits | path.startswith(p)
        else:
            body = p.rstrip("/")
            inner = glob_regex(body.lstrip("/"))[5:-1].replace(r".*.*/", r"(.*/)?").replace(".*.*", "\0").replace(".*", "[^/]*").replace("\0", ".*")
            start = "^" if "/" in body else "^(.*/)?"
            fits = path.rlike(start + inner + ("/" if p.endswith("/") else "(/|$)"))
        out = F.when(fits, not negate) if out is None else out.when(fits, not negate)
    return F.lit(False) if out is None else out.otherwise(False)


def above(path: Column) -> Column:
    """Array of the directories that hold a path, the outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def pruned(path: Column, patterns: list[str]) -> Column:
    """Whether a path or a directory that holds it is ignored; a later ! can't bring back what is below."""
    return ignored(path, patterns) | (path.contains("/") & F.exists(above(path), lambda d: ignored(d, patterns)))


def wanted(files: DataFrame, root: str | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Files inside the root, small enough, not ignored and not empty."""
    path = F.col("file")
    keep = small_enough(F.octet_length("text")) & (F.length("text") > 0)
    if root is not None:
        keep = keep & inside(path, root)
    return files.where(keep & ~pruned(path, patterns or []))
