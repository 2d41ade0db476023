"""Declared packages and what a snapshot of their registries says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftmark.functions.text import base_name, days_between, explode_lines
from siftmark.operators.findings import findings

PYPI, NPM = "PyPI", "npm"
ANSWERS = "registry string, package string, http_status int, created_at timestamp_ntz, fetched_at timestamp_ntz"
REGISTRY = "registry string, package string, http_status int, created_at timestamp_ntz"


def is_requirements(path: Column) -> Column:
    return base_name(path) == "requirements.txt"


def is_package_json(path: Column) -> Column:
    return base_name(path) == "package.json"


def required(line: Column) -> Column:
    """The name that a line of a requirements.txt begins with; empty where there is none."""
    return F.regexp_extract(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""), "^([a-zA-Z0-9._-]+)", 1)


def declared(text: Column) -> Column:
    """Array of the keys of both sections of a package.json, each once."""
    read = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    keys = lambda c: F.coalesce(F.map_keys(read[c]), F.array().cast("array<string>"))
    return F.array_union(keys("dependencies"), keys("devDependencies"))


def from_requirements(files: DataFrame, strict: bool = False) -> DataFrame:
    """(file, registry, package, ord): the name that each line of a requirements.txt begins with, repeated ones too.
    With strict, lines that begin with an option have none."""
    lines = explode_lines(files.where(is_requirements(F.col("file"))).select("file", "text"))
    rows = lines.select("file", F.lit(PYPI).alias("registry"), required(F.col("line_text")).alias("package"), F.col("line").alias("ord"))
    rows = rows.where("package <> ''")
    return rows.where(~F.col("package").startswith("-")) if strict else rows


def from_package_json(files: DataFrame) -> DataFrame:
    """(file, registry, package, ord): keys of both sections of a package.json, each once. Text that isn't a JSON
    object has none; a section that is null or missing is empty."""
    rows = files.where(is_package_json(F.col("file")) & (F.length("text") > 0))
    rows = rows.select("file", F.posexplode(declared(F.col("text"))).alias("_pos", "package"))
    return rows.select("file", F.lit(NPM).alias("registry"), "package", (F.col("_pos") + 1).cast("int").alias("ord"))


def first_upload(payloads: DataFrame) -> DataFrame:
    """(registry, package, http_status, created_at) of registry answers (registry, package, http_status, body). The
    earliest upload of any release, or the time of creation; null where it can't be read."""
    body = F.from_json("body", "releases map<string,array<struct<upload_time:string>>>, time struct<created:string>")
    times = F.transform(F.flatten(F.map_values(body["releases"])), lambda x: x["upload_time"])
    earliest = F.when(~F.exists(times, lambda x: x.isNull()), F.array_min(times))
    pypi = F.try_to_timestamp(earliest, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    npm = F.try_to_timestamp(body["time"]["created"], F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return payloads.select("registry", "package", "http_status", F.when(F.col("registry") == PYPI, pypi).otherwise(npm).cast("timestamp_ntz").alias("created_at"))


def risk(status: Column, created: Column, as_of: str) -> Column:
    """(severity, message) or null: missing packages are critical, those under 30 days high, under 90 medium."""
    age = days_between(F.lit(as_of).cast("timestamp_ntz"), created)
    told = lambda severity, *text: F.struct(F.lit(severity).alias("severity"), F.concat(*text).alias("message"))
    risk = F.when(status == 404, told("CRITICAL", F.lit("There is no such package in "), F.col("registry"), F.lit("; its name may be invented.")))
    risk = risk.when(age < 30, told("HIGH", F.lit("First published "), age.cast("string"), F.lit(" days ago; it may imitate another.")))
    return risk.when(age < 90, told("MEDIUM", F.lit("First published "), age.cast("string"), F.lit(" days ago.")))


def check(packages: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """Findings of packages whose registry answered 404 or first saw them lately; unknown packages give none. The
    registry has a row for each package; as_of is the time to count from."""
    found = packages.join(registry, ["registry", "package"], "left").withColumn("_risk", risk(F.col("http_status"), F.col("created_at"), as_of)).where("_risk IS NOT NULL")
    return findings(found, "dependency", registry="registry", package="package", severity="_risk.severity", message="_risk.message", rule_ord="ord")


def cached(packages: DataFrame, cache: DataFrame, as_of: str, offline: bool, hours: int = 24) -> DataFrame:
    """packages with state: fresh, stale (only used offline), or unknown; and the cached severity where one is used."""
    old = F.lit(as_of).cast("timestamp_ntz") - F.col("fetched_at") > F.expr(f"INTERVAL '{hours}' HOUR")
    state = F.when(F.col("fetched_at").isNull(), "unknown").when(~old, "fresh").when(F.lit(offline), "stale").otherwise("unknown")
    rows = packages.join(cache, ["registry", "package"], "left").withColumn("state", state)
    return rows.withColumn("severity", F.when(F.col("state") != "unknown", F.col("severity"))).select("registry", "package", "state", "severity")


def answers(packages: DataFrame, cache: DataFrame, snapshot: DataFrame | None, as_of: str, offline: bool, hours: int = 24) -> DataFrame:
    """(registry, package, http_status, created_at, fetched_at) of packages: what the cache says where it is fresh, or
    offline whatever its age, else what the snapshot says, fetched now. Packages that neither knows are left out."""
    old = F.lit(as_of).cast("timestamp_ntz") - F.col("fetched_at") > F.expr(f"INTERVAL '{hours}' HOUR")
    held = packages.join(cache, ["registry", "package"]).where(F.lit(offline) | ~old).select([c.split()[0] for c in ANSWERS.split(", ")])
    if snapshot is None or offline:
        return held
    asked = packages.join(held, ["registry", "package"], "left_anti").join(snapshot, ["registry", "package"])
    return held.unionByName(asked.select("registry", "package", "http_status", "created_at", F.lit(as_of).cast("timestamp_ntz").alias("fetched_at")))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Both, the latest row of each package; of rows of the same time the one whose other columns come first."""
    rest = [c for c in cache.columns if c not in ("registry", "package", "fetched_at")]
    latest = Window.partitionBy("registry", "package").orderBy(F.desc("fetched_at"), *rest)
    return cache.unionByName(new).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def _digest(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(columns))), 256)


def sealed(cache: DataFrame) -> DataFrame:
    """With integrity, a digest of the row."""
    return cache.withColumn("integrity", _digest(cache.columns))


def unbroken(cache: DataFrame) -> DataFrame:
    """Rows whose integrity is right, or that have none, without it."""
    plain = [c for c in cache.columns if c != "integrity"]
    return cache.where(F.col("integrity").isNull() | (F.col("integrity") == _digest(plain))).select(plain)
