"""Registered queries and the SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions import text as tx
from siftmark.operators import ast_strings as py
from siftmark.operators import blocks, dependencies, files, findings, layout, rules
from siftmark.plans import corpus as c
from siftmark.plans import scans
from siftmark.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Pieces of SQL

SHORT = ["file", "line", "rule_ord", "pattern_name", "rule_name", "package", "registry", "severity", "message", "value_preview", "matched_content", "remediation"]


def _lines(source: str, key: str = "file") -> str:
    """The lines of a subquery; an empty last one can't match a rule but is left out all the same."""
    return f"(SELECT {key}, line::INT AS line, line_text FROM (SELECT {key}, unnest(ls) AS line_text, generate_subscripts(ls, 1) AS line, len(ls) AS n FROM (SELECT {key}, string_split(text, chr(10)) AS ls FROM {source}) _) _ WHERE line < n OR line_text <> '')"


def _matches(source: str, table: tuple[rules.Rule, ...], key: str = "file") -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = (f"SELECT {key}, line, {k} AS rule_ord, {quoted(r.name)} AS rule_name, '{r.severity}' AS severity, {quoted(r.advice)} AS advice, regexp_extract(line_text, {quoted(r.pattern)}, 0) AS matched FROM l WHERE regexp_matches(line_text, {quoted(r.pattern)})" for k, r in enumerate(table))
    return f"(WITH l AS MATERIALIZED {_lines(source, key)} {' UNION ALL '.join(each)})"


MASK = "CASE WHEN length(matched) > 8 THEN left(matched, 4) || repeat('*', length(matched) - 8) || right(matched, 4) ELSE '****' END"
RANK = "CASE coalesce(severity, 'INFO') WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 4 END"
TEXT_FILE = r"regexp_matches(file, '\.(bash|js|json|log|md|ps1|py|sh|ts|txt|yaml|yml)$')"
AGENT_FILE = r"file LIKE '%.md' AND regexp_matches(regexp_extract(file, '^(.*)/[^/]*$', 1), '\.agent|\.cursor|\.github/copilot')"
DOCKER_FILE = "regexp_matches(regexp_extract(file, '[^/]*$'), 'Dockerfile|docker-compose')"
DOCS = c.DOCUMENTS_SQL
NAME = "regexp_extract(file, '[^/]*$')"
ALL = scans.ALL_SECRETS


def _where(source: str, condition: str) -> str:
    return f"(SELECT * FROM {source} _ WHERE {condition})"


def _files(rows: list[tuple[str, str]]) -> str:
    return c.sql_values(rows, "file, text")


# Lines, secrets


@query(f"SELECT doc_id, count(*) AS n_lines, sum(line)::BIGINT AS line_sum, max(length(line_text))::INT AS longest, sum(length(line_text))::BIGINT AS chars FROM {_lines('documents', 'doc_id')} GROUP BY doc_id")
def lines_explode(spark, sf):
    lines = tx.explode_lines(read_table(spark, f"{sf}/documents.parquet").select("doc_id", "text"))
    n = F.char_length("line_text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("line").alias("line_sum"), F.max(n).alias("longest"), F.sum(n).alias("chars"))


@query(f"SELECT file, line, rule_ord, rule_name, severity, {MASK} AS value_preview FROM {_matches(DOCS, ALL)}")
def secret_scan(spark, sf):
    found = rules.match_files(c.documents(spark, sf), ALL)
    return found.select("file", "line", "rule_ord", "rule_name", "severity", tx.mask(F.col("matched")).alias("value_preview"))


@query(f"SELECT file, line, rule_name, severity, {MASK} AS value_preview FROM {_matches(_where(DOCS, TEXT_FILE), ALL)}")
def secret_scan_ext_filter(spark, sf):
    found = rules.match_files(c.documents(spark, sf).where(files.is_text(F.col("file"))), ALL)
    return found.select("file", "line", "rule_name", "severity", tx.mask(F.col("matched")).alias("value_preview"))


@query(f"""SELECT file, line, rule_name, severity, greatest(0, least(4, {RANK} + regexp_matches(file, '{tx.MILD}')::INT - regexp_matches(file, '{tx.GRAVE}')::INT))::INT AS shifted_rank,
['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][greatest(0, least(4, {RANK} + regexp_matches(file, '{tx.MILD}')::INT - regexp_matches(file, '{tx.GRAVE}')::INT)) + 1] AS shifted_severity FROM {_matches(DOCS, ALL)}""")
def secret_severity_shift(spark, sf):
    found = rules.match_files(c.documents(spark, sf), ALL)
    moved = tx.shifted(tx.rank(F.col("severity")), F.col("file"))
    return found.select("file", "line", "rule_name", "severity", moved.alias("shifted_rank"), tx.severity_of(moved).alias("shifted_severity"))


def _false_positives(spark, sf):
    return c.documents(spark, sf).unionByName(c.files(spark, c.CHAT_FILES))


@query(f"SELECT file, line, rule_name, {MASK} AS value_preview FROM {_matches(f'({DOCS} UNION ALL {_files(c.CHAT_FILES)})', ALL)} WHERE NOT regexp_matches(matched, '{rules.FALSE_POSITIVE}')")
def secret_false_positive_filter(spark, sf):
    found = rules.match_files(_false_positives(spark, sf), ALL).where(~F.col("matched").rlike(rules.FALSE_POSITIVE))
    return found.select("file", "line", "rule_name", tx.mask(F.col("matched")).alias("value_preview"))


@query(f"SELECT file, line, rule_name, severity, {MASK} AS value_preview FROM {_matches(f"(SELECT 'conv/' || conv_id || '/' || turn AS file, text FROM conversations UNION ALL {_files(c.CHAT_FILES)})", ALL)}")
def secret_scan_chat(spark, sf):
    turns = read_table(spark, f"{sf}/conversations.parquet").select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("file"), "text")
    found = rules.match_files(turns.unionByName(c.files(spark, c.CHAT_FILES)), ALL)
    return found.select("file", "line", "rule_name", "severity", tx.mask(F.col("matched")).alias("value_preview"))


@query(f"SELECT file, line, rule_name, severity, {MASK} AS value_preview FROM {_matches('(SELECT url AS file, html AS text FROM pages)', ALL)}")
def secret_scan_pages(spark, sf):
    found = rules.match_files(read_table(spark, f"{sf}/pages.parquet").select(F.col("url").alias("file"), F.col("html").alias("text")), ALL)
    return found.select("file", "line", "rule_name", "severity", tx.mask(F.col("matched")).alias("value_preview"))


@query(f"SELECT file, line, rule_name, severity, matched FROM {_matches(DOCS, ALL)}")
def secret_scan_rule_table(spark, sf):
    """The same scan with rules from a DataFrame."""
    table = c.table(spark, [(k, r.name, r.pattern, r.severity, r.advice) for k, r in enumerate(ALL)], "rule_ord int, rule_name string, pattern string, severity string, advice string")
    return rules.match_table(tx.explode_lines(c.documents(spark, sf)), table).select("file", "line", "rule_name", "severity", "matched")


# Agents, containers


@query(f"SELECT file, line, rule_name, severity, matched AS matched_content, advice AS remediation FROM {_matches(_where(f'({_files(c.AGENT_FILES)} UNION ALL {DOCS})', AGENT_FILE), rules.AGENT)}")
def agent_rules_scan(spark, sf):
    tree = c.files(spark, c.AGENT_FILES).unionByName(c.documents(spark, sf))
    return scans.scan_agent_rules(tree).select("file", "line", "rule_name", "severity", "matched_content", "remediation")


@query(f"SELECT file, line, rule_name, severity, matched FROM {_matches(f'({DOCS} UNION ALL {_files(c.AGENT_FILES)})', rules.AGENT)}")
def agent_rules_documents(spark, sf):
    """Every document, and every small file, taken for a rule file, as a single target is."""
    return rules.match_files(c.documents(spark, sf).unionByName(c.files(spark, c.AGENT_FILES)), rules.AGENT).select("file", "line", "rule_name", "severity", "matched")


@query(f"SELECT file, line, rule_name, severity, advice AS message FROM {_matches(_where(f'({_files(c.DOCKER_FILES)} UNION ALL {DOCS})', DOCKER_FILE), rules.DOCKER)}")
def docker_risk_scan(spark, sf):
    tree = c.files(spark, c.DOCKER_FILES).unionByName(c.documents(spark, sf))
    return scans.scan_docker(tree).select("file", "line", "rule_name", "severity", "message")


@query(c.sql_values([("src/a.py", 1, "Cloud access key (AST Concat)", "AKIA************6789"), ("src/a.py", 2, "Cloud access key", "AKIA************6789"), ("src/b.py", 2, "Password", "pass" + "*" * 14 + "alue"), ("src/c.py", 1, "Cloud access key (AST Concat)", "AKIA************6789"), ("src/c.py", 2, "Password", "pass" + "*" * 12 + "et99")], "file, line, pattern_name, value_preview")[1:-1])
def ast_secret_scan(spark, sf):
    """Against rows derived by hand."""
    return py.ast_secrets(c.files(spark, c.PYTHON_FILES), rules.SECRETS).select("file", "line", "pattern_name", "value_preview")


_STRINGS = [("src/a.py", 1, "AKIA" + "ABCDEFGH23456789", True), ("src/a.py", 2, "AKIA" + "ABCDEFGH23456789", False), ("src/b.py", 2, "password: hidden_value", False), ("src/b.py", 3, "AKIA", False), ("src/b.py", 3, "ABCDEFGH23456789", False), ("src/c.py", 1, "AKIA" + "ABCDEFGH23456789", True), ("src/c.py", 2, "password=topsecret99 ", False)]


@query(c.sql_values(_STRINGS, "file, line, value, is_concat")[1:-1])
def ast_strings_documents(spark, sf):
    """Against rows derived by hand, as no document is a Python source."""
    return py.ast_strings(c.documents(spark, sf).unionByName(c.files(spark, c.PYTHON_FILES)))


# Packages

_REQ = rf"(SELECT file, 'PyPI' AS registry, regexp_extract(trim(line_text), '^([a-zA-Z0-9._-]+)', 1) AS package, line AS ord FROM {_lines(_where(_files(c.PACKAGE_FILES), NAME + " = 'requirements.txt'"))} WHERE regexp_matches(trim(line_text), '^[a-zA-Z0-9._-]'))"
_JSON = f"""(SELECT file, 'npm' AS registry, package, ord::INT AS ord FROM (SELECT file, unnest(ks) AS package, generate_subscripts(ks, 1) AS ord FROM (
SELECT file, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS ks FROM (SELECT file, coalesce(json_keys(text, '$.dependencies'), []::VARCHAR[]) AS a, coalesce(json_keys(text, '$.devDependencies'), []::VARCHAR[]) AS b
FROM {_where(_files(c.PACKAGE_FILES), NAME + " = 'package.json' AND json_valid(text)")} _) _) _) _)"""
_REGISTRY = f"(SELECT registry, package, http_status, created_at::TIMESTAMP AS created_at FROM {c.sql_values(c.REGISTRY, 'registry, package, http_status, created_at')} _)"
_AGE = f"floor((epoch_us(TIMESTAMP '{c.AS_OF}') - epoch_us(created_at)) / 86400000000)::INT"
_CHECKED = f"""(SELECT registry, package, ord, CASE WHEN http_status = 404 THEN 'CRITICAL' WHEN {_AGE} < 30 THEN 'HIGH' WHEN {_AGE} < 90 THEN 'MEDIUM' END AS severity,
CASE WHEN http_status = 404 THEN 'There is no such package in ' || registry || '; its name may be invented.' WHEN {_AGE} < 30 THEN 'First published ' || {_AGE} || ' days ago; it may imitate another.' WHEN {_AGE} < 90 THEN 'First published ' || {_AGE} || ' days ago.' END AS message
FROM ({_REQ} UNION ALL {_JSON}) p LEFT JOIN {_REGISTRY} r USING (registry, package))"""


@query(_REQ[1:-1])
def requirements_parse(spark, sf):
    return dependencies.from_requirements(c.files(spark, c.PACKAGE_FILES))


@query(_JSON[1:-1])
def package_json_parse(spark, sf):
    return dependencies.from_package_json(c.files(spark, c.PACKAGE_FILES))


@query(f"SELECT registry, package, severity, message FROM {_CHECKED} WHERE severity IS NOT NULL")
def dependency_age(spark, sf):
    return scans.scan_dependencies(c.files(spark, c.PACKAGE_FILES), _how(spark)).select("registry", "package", "severity", "message")


@query(c.sql_values([("PyPI", "a", 200, "2019-05-01 10:00:00"), ("PyPI", "b", 200, None), ("PyPI", "c", 404, None), ("PyPI", "d", 200, None), ("npm", "e", 200, "2025-12-25 01:02:03.456000"), ("npm", "f", 200, None)], "registry, package, http_status, created_at").replace("SELECT *", "SELECT registry, package, http_status, created_at::TIMESTAMP AS created_at")[1:-1])
def registry_first_upload(spark, sf):
    """Against rows derived by hand."""
    return dependencies.first_upload(c.table(spark, c.PAYLOADS, "registry string, package string, http_status int, body string"))


def _cache_sql(offline: bool) -> str:
    old = f"TIMESTAMP '{c.AS_OF}' - fetched_at > INTERVAL 24 HOURS"
    state = f"CASE WHEN fetched_at IS NULL THEN 'unknown' WHEN NOT ({old}) THEN 'fresh' ELSE '{'stale' if offline else 'unknown'}' END"
    return f"SELECT registry, package, {offline} AS offline, {state} AS state, CASE WHEN {state} <> 'unknown' THEN severity END AS severity FROM {_REGISTRY} p LEFT JOIN (SELECT registry, package, fetched_at::TIMESTAMP AS fetched_at, severity FROM {c.sql_values(c.CACHE, 'registry, package, fetched_at, severity')} _) q USING (registry, package)"


@query(_cache_sql(True) + " UNION ALL " + _cache_sql(False))
def dependency_cache_ttl(spark, sf):
    packages = c.registry(spark).select("registry", "package")
    cache = dependencies.unbroken(dependencies.sealed(c.cache(spark)))
    parts = [dependencies.cached(packages, cache, c.AS_OF, offline).select("registry", "package", F.lit(offline).alias("offline"), "state", "severity") for offline in (True, False)]
    return parts[0].unionByName(parts[1])


_CACHE_SQL = f"(SELECT registry, package, fetched_at::TIMESTAMP AS fetched_at, severity FROM {c.sql_values(c.CACHE, 'registry, package, fetched_at, severity')} _)"


@query(f"SELECT registry, package, fetched_at, severity FROM (SELECT *, row_number() OVER (PARTITION BY registry, package ORDER BY fetched_at DESC, severity NULLS FIRST) AS n FROM ({_CACHE_SQL} UNION ALL (SELECT registry, package, fetched_at + INTERVAL 24 HOURS, 'LOW' FROM {_CACHE_SQL} _ WHERE registry = 'npm')) _) _ WHERE n = 1")
def cache_upsert(spark, sf):
    old = c.cache(spark)
    new = old.where("registry = 'npm'").withColumns({"fetched_at": F.col("fetched_at") + F.expr("INTERVAL '24' HOUR"), "severity": F.lit("LOW")})
    return dependencies.upsert(old, new)


# Paths


def _ignored_sql(path: str, patterns: list[str]) -> str:
    cases = ""
    for p in patterns:
        body, g = p.removeprefix("!"), tx.glob_regex(p.removeprefix("!"))
        fits = f"regexp_matches({path}, '{g}') OR regexp_matches(regexp_extract({path}, '[^/]*$'), '{g}')" + (f" OR starts_with({path}, '{body}')" if body.endswith("/") else "")
        cases += f" WHEN {fits} THEN {not p.startswith('!')}"
    return f"(CASE{cases} ELSE false END)"


@query(f"SELECT file, {_ignored_sql('file', c.IGNORE)} AS ignored FROM {DOCS}")
def ignore_first_match(spark, sf):
    return c.documents(spark, sf).select("file", files.ignored(F.col("file"), c.IGNORE).alias("ignored"))


_UP1, _UP2 = "string_split(file, '/')[1]", "array_to_string(string_split(file, '/')[1:2], '/')"


@query(f"SELECT file FROM {DOCS} WHERE NOT ({_ignored_sql('file', c.IGNORE_DIRS)} OR {_ignored_sql(_UP1, c.IGNORE_DIRS)} OR {_ignored_sql(_UP2, c.IGNORE_DIRS)})")
def ignore_dir_prune(spark, sf):
    return c.documents(spark, sf).where(~files.pruned(F.col("file"), c.IGNORE_DIRS)).select("file")


@query(f"SELECT file, line AS ord, trim(line_text, chr(9) || chr(10) || chr(13) || ' ') AS pattern FROM {_lines(_where(_files(c.IGNORE_FILES), NAME + " = '.siftmarkignore'"))} _ WHERE regexp_matches(line_text, '^\\s*[^#\\s]')")
def ignore_file_parse(spark, sf):
    return files.ignore_patterns(c.files(spark, c.IGNORE_FILES), ".siftmarkignore")


@query(f"SELECT file FROM {DOCS} WHERE starts_with(file, 'docs/src4/')")
def path_containment(spark, sf):
    return c.documents(spark, sf).where(files.inside(F.col("file"), "docs/src4")).select("file")


@query(f"SELECT doc_id, strlen(text)::INT AS n_bytes FROM documents WHERE strlen(text) <= {files.MOST_BYTES} AND strlen(text) > 0")
def size_cap(spark, sf):
    n = F.octet_length("text")
    return read_table(spark, f"{sf}/documents.parquet").where(files.small_enough(n) & (n > 0)).select("doc_id", n.alias("n_bytes"))


# Findings of a whole scan

_TREE = f"({' UNION ALL '.join([DOCS, *map(_files, (c.CHAT_FILES, c.AGENT_FILES, c.DOCKER_FILES, c.PACKAGE_FILES))])})"
_NULL = {k: f"NULL::{'INT' if k in ('line', 'rule_ord') else 'VARCHAR'}" for k in SHORT}


def _shape(check: str, source: str, **given: str) -> str:
    return f"SELECT '{check}' AS \"check\", " + ", ".join(f"{given.get(k, _NULL[k])} AS {k}" for k in SHORT) + f" FROM {source} _"


_FULL = "(" + " UNION ALL ".join((
    _shape("dependency", _where(_CHECKED, "severity IS NOT NULL"), rule_ord="ord", package="package", registry="registry", severity="severity", message="message"),
    _shape("secret", _matches(_where(_TREE, TEXT_FILE), ALL), file="file", line="line", rule_ord="rule_ord", pattern_name="rule_name", severity="severity", value_preview=MASK),
    _shape("agent_rule", _matches(_where(_TREE, AGENT_FILE), rules.AGENT), file="file", line="line", rule_ord="rule_ord", rule_name="rule_name", severity="severity", matched_content="matched", remediation="advice"),
    _shape("docker", _matches(_where(_TREE, DOCKER_FILE), rules.DOCKER), file="file", line="line", rule_ord="rule_ord", rule_name="rule_name", severity="severity", message="advice"),
)) + ")"


def _tree(spark, sf):
    tree = c.documents(spark, sf)
    for rows in (c.CHAT_FILES, c.AGENT_FILES, c.DOCKER_FILES, c.PACKAGE_FILES):
        tree = tree.unionByName(c.files(spark, rows))
    return tree


def _how(spark, severity="INFO"):
    return scans.Scan(registry=c.registry(spark), as_of=c.AS_OF, severity=severity)


def _full(spark, sf, severity="INFO"):
    return scans.full_scan(_tree(spark, sf), _how(spark, severity))


@query(f'SELECT "check", {", ".join(SHORT)} FROM {_FULL}')
def full_scan_union(spark, sf):
    return _full(spark, sf).select("check", *SHORT)


@query(f'SELECT "check", file, line, rule_ord, package, severity FROM {_FULL} WHERE {RANK} <= 1')
def severity_threshold(spark, sf):
    return _full(spark, sf, "HIGH").select("check", "file", "line", "rule_ord", "package", "severity")


@query(f"SELECT severity, count(*) AS n FROM {_FULL} GROUP BY severity")
def severity_histogram(spark, sf):
    return findings.histogram(_full(spark, sf))


@query(f'SELECT "check", file, line, rule_ord, package, severity FROM {_FULL} ORDER BY {RANK}, "check", file, line')
def severity_sorted(spark, sf):
    return findings.ordered(_full(spark, sf)).select("check", "file", "line", "rule_ord", "package", "severity")


@query(f"SELECT (count(*) > 0)::INT AS exit_code FROM {_FULL} WHERE {RANK} = 0")
def exit_code(spark, sf):
    return findings.exit_code(_full(spark, sf, "CRITICAL"))


@query(f"SELECT coalesce(pattern_name, rule_name, package, 'Issue') AS title, CASE WHEN line IS NOT NULL THEN file || ':' || line ELSE coalesce(file, 'N/A') END AS location, severity FROM {_FULL}")
def finding_title_loc(spark, sf):
    return findings.titled(_full(spark, sf)).select("title", "location", "severity")


@query(f"SELECT severity, rpad(coalesce(severity, 'INFO'), 10, ' ') || ' ' || coalesce(pattern_name, rule_name, package, 'Issue') AS headline, CASE WHEN line IS NOT NULL THEN file || ':' || line ELSE coalesce(file, 'N/A') END AS location FROM {_FULL}")
def report_headlines(spark, sf):
    return findings.lines(_full(spark, sf))


_JSON_FIELDS = ", ".join(f"'{k}', \"{k}\"" for k in ["check", *SHORT] if k != "rule_ord")


@query(f"SELECT json_merge_patch('{{}}', json_object({_JSON_FIELDS}))::VARCHAR AS finding FROM {_FULL}")
def findings_json(spark, sf):
    return findings.as_json(_full(spark, sf))


@query(f"SELECT * FROM ({' UNION ALL '.join([_shape('secret', _matches(_where(_files(c.DEMO_FILES), TEXT_FILE), ALL), file='file', line='line', pattern_name='rule_name', severity='severity'), _shape('dependency', _where(_CHECKED, "severity IS NOT NULL AND registry = 'PyPI'"), package='package', severity='severity'), _shape('agent_rule', _matches(_where(_files(c.DEMO_FILES), AGENT_FILE), rules.AGENT), file='file', line='line', rule_name='rule_name', severity='severity'), _shape('docker', _matches(_where(_files(c.DEMO_FILES), DOCKER_FILE), rules.DOCKER), file='file', line='line', rule_name='rule_name', severity='severity')])}) _".replace("SELECT * FROM", 'SELECT "check", file, line, coalesce(pattern_name, rule_name, package) AS title, severity FROM', 1))
def demo_scan(spark, sf):
    return findings.titled(scans.full_scan(c.demo(spark), _how(spark))).select("check", "file", "line", "title", "severity")


# Layout

_PLACES = f"(SELECT file FROM {_files(c.AGENT_FILES)} UNION ALL SELECT file FROM {_files(c.DOCKER_FILES)})"
_WITH_TEXT = f"({_files(c.AGENT_FILES)} UNION ALL {_files(c.DOCKER_FILES)})"
_MANIFEST = c.sql_values(c.MANIFEST, "check_id, kind, path, literal, message")
_BROKEN = f"""(SELECT check_id, kind, path, literal, message FROM {_MANIFEST} m WHERE CASE kind
WHEN 'file' THEN NOT EXISTS (SELECT 1 FROM {_PLACES} f WHERE f.file = m.path)
WHEN 'dir' THEN NOT EXISTS (SELECT 1 FROM {_PLACES} f WHERE starts_with(f.file, m.path || '/'))
WHEN 'absent' THEN EXISTS (SELECT 1 FROM {_PLACES} f WHERE f.file = m.path OR starts_with(f.file, m.path || '/'))
WHEN 'literal' THEN NOT EXISTS (SELECT 1 FROM {_WITH_TEXT} f WHERE f.file = m.path AND contains(f.text, m.literal))
ELSE EXISTS (SELECT 1 FROM {_WITH_TEXT} f WHERE f.file = m.path AND contains(f.text, m.literal)) END)"""


def _layout(spark):
    return layout.violations(c.files(spark, c.AGENT_FILES).unionByName(c.files(spark, c.DOCKER_FILES)), c.manifest(spark))


@query(f"SELECT check_id, kind, path, message FROM {_BROKEN} WHERE kind IN ('file', 'dir')")
def layout_missing(spark, sf):
    return _layout(spark).where("kind IN ('file', 'dir')").select("check_id", "kind", "path", "message")


@query(f"SELECT check_id, path, message FROM {_BROKEN} WHERE kind = 'absent'")
def layout_forbidden(spark, sf):
    return _layout(spark).where("kind = 'absent'").select("check_id", "path", "message")


@query(f"SELECT check_id, kind, path, literal, message FROM {_BROKEN} WHERE kind IN ('literal', 'forbidden')")
def contract_literals(spark, sf):
    return _layout(spark).where("kind IN ('literal', 'forbidden')").select("check_id", "kind", "path", "literal", "message")


@query(f"SELECT check_id, kind, path, message FROM {_BROKEN} ORDER BY check_id LIMIT 1")
def first_violation(spark, sf):
    return layout.first_violation(_layout(spark)).select("check_id", "kind", "path", "message")


@query(f"SELECT coalesce(a.skill, b.skill) AS skill, CASE WHEN a.skill IS NULL THEN 'left' ELSE 'right' END AS missing_in FROM {c.sql_values(c.SKILLS[0], 'skill')} a FULL JOIN {c.sql_values(c.SKILLS[1], 'skill')} b ON a.skill = b.skill WHERE a.skill IS NULL OR b.skill IS NULL")
def skill_parity(spark, sf):
    return layout.parity(c.table(spark, c.SKILLS[0], "skill string"), c.table(spark, c.SKILLS[1], "skill string"), "skill")


@query(f"SELECT file FROM {c.sql_values(c.SKILL_FILES, 'file')} _ WHERE {NAME} = 'SKILL.md' AND NOT contains('/' || file, '/.agents/skills/')")
def skill_misplaced(spark, sf):
    return layout.misplaced(c.table(spark, c.SKILL_FILES, "file string"), "SKILL.md", ".agents/skills")


@query(f"""SELECT skill, CASE WHEN coalesce(trim(target), '') = '' THEN 'empty' WHEN NOT EXISTS (SELECT 1 FROM {c.sql_values(c.SKILL_FILES, 'file')} f WHERE regexp_extract(file, '^(.*)/[^/]*$', 1) = target) THEN 'no directory' ELSE 'no definition' END AS problem
FROM {c.sql_values(c.SKILL_META, 'skill, target')} m WHERE coalesce(trim(target), '') = '' OR NOT EXISTS (SELECT 1 FROM {c.sql_values(c.SKILL_FILES, 'file')} f WHERE file = target || '/SKILL.md')""")
def skill_mirror(spark, sf):
    return layout.mirror_problems(c.table(spark, c.SKILL_META, "skill string, target string"), c.table(spark, c.SKILL_FILES, "file string"))


@query(f"SELECT path, should_exist FROM {c.sql_values(c.EXPECTED, 'path, should_exist')} e WHERE should_exist <> EXISTS (SELECT 1 FROM {_PLACES} f WHERE f.file = e.path)")
def expected_state(spark, sf):
    return layout.unexpected(c.files(spark, c.AGENT_FILES).unionByName(c.files(spark, c.DOCKER_FILES)), c.table(spark, c.EXPECTED, "path string, should_exist boolean"))


@query(f"""SELECT source, target, CASE WHEN e.file IS NULL THEN 'create' WHEN overwrite THEN 'overwrite' ELSE 'keep' END AS action FROM (
SELECT f.file AS source, target_dir || substr(f.file, length(source_dir) + 1) AS target, overwrite FROM {_PLACES} f JOIN {c.sql_values(c.MAPPING, 'source_dir, target_dir, overwrite')} m ON starts_with(f.file, source_dir || '/')) p LEFT JOIN {c.sql_values(c.EXISTING, 'file')} e ON e.file = target""")
def copy_plan(spark, sf):
    tree = c.files(spark, c.AGENT_FILES).unionByName(c.files(spark, c.DOCKER_FILES))
    return layout.copy_plan(tree, c.table(spark, c.MAPPING, "source_dir string, target_dir string, overwrite boolean"), c.table(spark, c.EXISTING, "file string"))


_PATTERNS = c.sql_values(c.MANIFEST_PATTERNS, "check_id, kind, path, literal, message")


@query(f"SELECT check_id, kind, path, message FROM {_PATTERNS} m WHERE (kind = 'pattern') <> EXISTS (SELECT 1 FROM {_WITH_TEXT} f WHERE f.file = m.path AND regexp_matches(f.text, m.literal))")
def contract_patterns(spark, sf):
    """Regular expressions, case left out."""
    tree = c.files(spark, c.AGENT_FILES).unionByName(c.files(spark, c.DOCKER_FILES))
    return layout.violations(tree, c.table(spark, c.MANIFEST_PATTERNS, c.MANIFEST_SCHEMA)).select("check_id", "kind", "path", "message")


@query(f"SELECT check_id, kind, path, message FROM {c.sql_values(c.PROBES, 'check_id, kind, path, literal, message')} m WHERE (kind = 'literal') <> EXISTS (SELECT 1 FROM {_files(c.ENCODED)} f WHERE f.file = m.path AND contains(f.text, m.literal))")
def encoding_probes(spark, sf):
    """Sentences that are there as they were written, and not decoded twice."""
    return layout.violations(c.files(spark, c.ENCODED), c.table(spark, c.PROBES, c.MANIFEST_SCHEMA)).select("check_id", "kind", "path", "message")


_SECTIONS = [("missing",), ("misplaced",), ("parity",), ("unexpected",)]


@query(f"""WITH p AS (SELECT 'missing' AS section, path AS item FROM {_BROKEN} _ WHERE kind IN ('file', 'dir')
UNION ALL SELECT 'misplaced', file FROM {c.sql_values(c.SKILL_FILES, 'file')} _ WHERE {NAME} = 'SKILL.md' AND NOT contains('/' || file, '/.agents/skills/')
UNION ALL SELECT 'parity', skill FROM (SELECT coalesce(a.skill, b.skill) AS skill FROM {c.sql_values(c.SKILLS[0], 'skill')} a FULL JOIN {c.sql_values(c.SKILLS[1], 'skill')} b ON a.skill = b.skill WHERE a.skill IS NULL OR b.skill IS NULL) _)
SELECT section, count(item) = 0 AS ok, count(item) AS problems, coalesce(string_agg(DISTINCT item, ', ' ORDER BY item), '') AS items FROM {c.sql_values(_SECTIONS, 'section')} s LEFT JOIN p USING (section) GROUP BY section""")
def path_audit(spark, sf):
    """A report that never fails: each section, whether it is in order, and what isn't."""
    left, right = (c.table(spark, x, "skill string") for x in c.SKILLS)
    parts = {"missing": _layout(spark).where("kind IN ('file', 'dir')").select("path"), "misplaced": layout.misplaced(c.table(spark, c.SKILL_FILES, "file string"), "SKILL.md", ".agents/skills"), "parity": layout.parity(left, right, "skill").select("skill")}
    return layout.audit(c.table(spark, _SECTIONS, "section string"), parts)


# Blocks

_BLOCK_LINES = _lines(_files(c.BLOCK_FILES))
_START, _END = c.BLOCK["starts"][0], c.BLOCK["end"]
_EXTRACTED = f"""(WITH l AS (SELECT * FROM {_BLOCK_LINES} _), s AS (SELECT file, min(line) AS s FROM l WHERE line_text = '{_START}' GROUP BY file),
e AS (SELECT file, min(line) AS e FROM l JOIN s USING (file) WHERE line_text = '{_END}' AND line >= s GROUP BY file)
SELECT file, line, line_text FROM l JOIN s USING (file) LEFT JOIN e USING (file) WHERE line >= s AND line <= coalesce(e, line))"""
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_STRIPPED = f"""(WITH l AS (SELECT *, CASE WHEN line_text IN {_IN(c.BLOCK['starts'])} THEN 1 WHEN line_text = '{_END}' THEN 0 END AS mark FROM {_BLOCK_LINES} _)
SELECT file, line, line_text FROM l WHERE mark IS NULL AND (coalesce((SELECT m.mark FROM l m WHERE m.file = l.file AND m.line < l.line AND m.mark IS NOT NULL ORDER BY m.line DESC LIMIT 1), 0) = 0
OR EXISTS (SELECT 1 FROM l x WHERE x.file = l.file AND x.line <= l.line AND x.mark IS NULL AND x.line_text NOT IN {_IN(['', *c.BLOCK['managed']])} AND x.line > (SELECT max(m.line) FROM l m WHERE m.file = l.file AND m.line < l.line AND m.mark IS NOT NULL))))"""
_TRIMMED = "(SELECT t.file, t.line, t.line_text FROM {0} t JOIN (SELECT file, max(line) AS m FROM {0} _ WHERE line_text <> '' GROUP BY file) k ON k.file = t.file AND t.line <= m)"


def _block_lines(spark):
    return tx.explode_lines(c.files(spark, c.BLOCK_FILES))


@query(_EXTRACTED[1:-1])
def block_extract(spark, sf):
    return blocks.extract(_block_lines(spark), _START, _END)


@query(_STRIPPED[1:-1])
def block_strip(spark, sf):
    return blocks.strip(_block_lines(spark), **c.BLOCK)


@query(_TRIMMED.format(_BLOCK_LINES)[1:-1])
def trailing_trim(spark, sf):
    return blocks.trim_end(_block_lines(spark))


_NUMBERED = f"(SELECT file, (row_number() OVER (PARTITION BY file ORDER BY line))::INT AS line, line_text FROM {_TRIMMED.format(_STRIPPED)} _)"


@query(f"SELECT * FROM {_NUMBERED} UNION ALL SELECT file, (m + k)::INT AS line, line_text FROM (SELECT file, max(line) AS m FROM {_NUMBERED} _ GROUP BY file) _, {c.sql_values([(k + 1, x) for k, x in enumerate(['', *c.NEW_BLOCK])], 'k, line_text')} _")
def block_rewrite(spark, sf):
    return blocks.rewrite(_block_lines(spark), block=c.NEW_BLOCK, **c.BLOCK)


@query(f"SELECT kind, literal, message FROM {c.sql_values(c.CONTRACT, 'kind, literal, message')} m WHERE (kind = 'forbidden') = EXISTS (SELECT 1 FROM {_EXTRACTED} e WHERE e.file = 'a.ignore' AND line_text = literal)")
def block_contract(spark, sf):
    block = blocks.extract(_block_lines(spark), _START, _END).where("file = 'a.ignore'")
    return layout.line_contract(block, c.table(spark, c.CONTRACT, "kind string, literal string, message string")).select("kind", "literal", "message")


# Contents

_RAW = [("a", "EFBBBF610A"), ("b", "61FF0A"), ("c", "610062"), ("d", "610D0A620A"), ("e", "610D0A620D0A"), ("f", "61D00A0D"), ("g", "")]
_ISSUES = [("a", "bom"), ("b", "invalid_utf8"), ("c", "nul"), ("d", "mixed_eol"), ("f", "invalid_utf8")]


@query(f"{c.sql_values([i for i in _ISSUES if i != ('c', 'nul')], 'file, issue')[1:-1]} UNION ALL SELECT doc_id::VARCHAR AS file, 'mixed_eol' AS issue FROM documents WHERE contains(text, chr(13) || chr(10)) AND len(string_split(text, chr(10))) > len(string_split(text, chr(13) || chr(10)))")
def text_integrity_new(spark, sf):
    """Issues of the documents and some bytes, less a baseline; the bytes against rows derived by hand."""
    raw = c.table(spark, _RAW, "file string, code string").select("file", F.unhex("code").alias("data"))
    docs = read_table(spark, f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), F.col("text").cast("binary").alias("data"))
    return layout.regressions(layout.text_issues(docs.unionByName(raw), "file"), c.table(spark, [("c", "nul"), ("z", "bom")], "file string, issue string"))


@query("""SELECT event_id, user_id, n <= 30 AND size <= 2000 OR k <= 5 AS retained FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, sum(strlen(props)) OVER (PARTITION BY user_id) AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) _""")
def worklog_retention(spark, sf):
    events = read_table(spark, f"{sf}/events.parquet")
    return layout.retained(events, "user_id", [F.desc("ts"), F.desc("event_id")], 30, 5, F.octet_length("props"), 2000).select("event_id", "user_id", "retained")
