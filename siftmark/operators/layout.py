"""Validation of a tree: what must be there, what must not, and what files must say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.functions.text import base_name, directory
from siftmark.operators.files import above

KINDS = ("file", "dir", "absent", "literal", "forbidden", "pattern", "unlike")


def violations(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(check_id, kind, path, literal, message) of the manifest rows that the tree breaks.

    file and dir ask for a path, absent forbids one. literal asks for a text in a file, forbidden for its absence; a
    missing file breaks literal and not forbidden. pattern and unlike do the same by regular expressions, in which (?i)
    leaves case out. A directory exists where a file is below it.
    """
    places = manifest.select("path").distinct()
    dirs = files.where(F.col("file").contains("/")).select(F.explode(above(F.col("file"))).alias("path")).where("path <> ''").join(places, "path", "left_semi").distinct()
    known = files.select(F.col("file").alias("path"), "text", F.lit(False).alias("is_dir")).join(places, "path", "left_semi")
    known = known.unionByName(dirs.select("path", F.lit(None).cast("string").alias("text"), F.lit(True).alias("is_dir")))
    joined = manifest.join(known, "path", "left")
    is_file, is_dir = F.col("is_dir") == F.lit(False), F.col("is_dir") == F.lit(True)
    has = F.coalesce(F.contains(F.col("text"), F.col("literal")), F.lit(False))
    broken = F.when(F.col("kind") == "file", ~F.coalesce(is_file, F.lit(False))).when(F.col("kind") == "dir", ~F.coalesce(is_dir, F.lit(False))).when(F.col("kind") == "absent", F.col("is_dir").isNotNull()).when(F.col("kind") == "literal", ~has).when(F.col("kind") == "forbidden", has)
    fits = F.coalesce(F.regexp_like("text", "literal"), F.lit(False))
    broken = broken.when(F.col("kind") == "pattern", ~fits).when(F.col("kind") == "unlike", fits)
    return joined.where(broken).select("check_id", "kind", "path", "literal", "message").distinct()


def first_violation(broken: DataFrame) -> DataFrame:
    """The one of the least check_id, where a run that stops at the first would stop."""
    return broken.orderBy("check_id", "path").limit(1)


def line_contract(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of manifest (kind, literal, message) that line_text breaks: `literal` lines must occur exactly, `forbidden` ones must not."""
    said = lines.select(F.col("line_text").alias("literal")).distinct()
    return manifest.where("kind = 'literal'").join(said, "literal", "left_anti").unionByName(manifest.where("kind = 'forbidden'").join(said, "literal", "left_semi"))


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, missing_in) of keys that only one side has: `left` or `right`."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full").where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_a").isNull(), "left").otherwise("right").alias("missing_in"))


def audit(required: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(section, ok, problems, items): a row for each section of a report that never fails, with how many of its items
    are problems and which, in order. parts: problems by section, in their first column; required: (section) of all."""
    told = None
    for section, rows in parts.items():
        one = rows.select(F.lit(section).alias("section"), F.col(rows.columns[0]).cast("string").alias("item"))
        told = one if told is None else told.unionAll(one)
    counted = told.groupBy("section").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("item")), ", ").alias("items"))
    return required.join(counted, "section", "left").select("section", F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("problems"), F.coalesce("items", F.lit("")).alias("items"))


def misplaced(files: DataFrame, name: str, place: str) -> DataFrame:
    """Files of a name that lie outside a place, which is a directory path at any depth."""
    return files.where((base_name(F.col("file")) == name) & ~F.concat(F.lit("/"), directory(F.col("file")), F.lit("/")).contains(f"/{place}/")).select("file")


def mirror_problems(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """(skill, problem) of metadata (skill, target): no target, no such directory, or no SKILL.md in it."""
    own = files.select(directory(F.col("file")).alias("target"), (base_name(F.col("file")) == "SKILL.md").alias("_defines")).groupBy("target").agg(F.max("_defines").alias("_defines"))
    joined = metadata.join(own, "target", "left")
    problem = F.when(F.coalesce(F.trim("target"), F.lit("")) == "", "empty").when(F.col("_defines").isNull(), "no directory").when(~F.col("_defines"), "no definition")
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("skill", "problem")


def text_issues(files: DataFrame, key: str, data: str = "data") -> DataFrame:
    """(key, issue) of binary contents: bom, invalid_utf8, nul, mixed_eol."""
    raw = F.col(data).cast("binary")
    byte = lambda *x: F.lit(bytearray(x))
    bare = F.replace(raw.cast("string"), F.lit("\r\n"), F.lit(""))  # strings are compared by their bytes, valid or not
    issues = F.array(
        F.when(F.startswith(raw, byte(0xEF, 0xBB, 0xBF)), "bom"), F.when(~F.is_valid_utf8(raw), "invalid_utf8"),
        F.when(F.contains(raw, byte(0)), "nul"), F.when(F.contains(raw, byte(0x0D, 0x0A)) & F.contains(bare, F.lit("\n")), "mixed_eol"),
    )
    return files.select(key, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def regressions(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """Issues that the baseline doesn't have."""
    return issues.join(baseline, issues.columns, "left_anti")


def unexpected(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, should_exist) of expected where the tree differs."""
    return expected.join(files.select(F.col("file").alias("path"), F.lit(1).alias("_there")).distinct(), "path", "left").where("should_exist <> (_there IS NOT NULL)").select("path", "should_exist")


def copy_plan(files: DataFrame, mapping: DataFrame, existing: DataFrame) -> DataFrame:
    """(source, target, action) for mapping (source_dir, target_dir, overwrite): files below source_dir go below target_dir;
    action is create, overwrite or keep. Nothing is copied."""
    below = files.where(F.col("file").contains("/")).select(F.col("file").alias("source"), F.explode(above(F.col("file"))).alias("source_dir"))
    joined = below.join(mapping, "source_dir")
    planned = joined.withColumn("target", F.concat("target_dir", F.expr("substring(source, char_length(source_dir) + 1)")))
    there = existing.select(F.col("file").alias("target"), F.lit(True).alias("_there")).distinct()
    action = F.when(F.col("_there").isNull(), "create").when(F.col("overwrite"), "overwrite").otherwise("keep")
    return planned.join(there, "target", "left").select("source", "target", action.alias("action"))


def retained(logs: DataFrame, key: str, order: list[Column], most_rows: int, keep: int, size: Column | None = None, most_size: int | None = None) -> DataFrame:
    """logs with retained: all rows of a log within the limits, the latest `keep` of one beyond either."""
    own = Window.partitionBy(key)
    over = F.count("*").over(own) > most_rows
    if size is not None:
        over = over | (F.sum(size).over(own) > most_size)
    return logs.withColumn("retained", ~over | (F.row_number().over(own.orderBy(*order)) <= keep))
