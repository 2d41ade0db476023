import http.server
import io
import json
import os
import random
import re
import threading
from contextlib import contextmanager, redirect_stdout

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmark import cli, report
from siftmark.functions import text as tx
from siftmark.operators import ast_strings, blocks, dependencies, files, findings, layout, rules
from siftmark.plans import corpus, queries, scans
from siftmark.sources.repofiles import read_repo
from siftmark.streaming.scan import scan_new

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_queries_without_sql_give_rows(spark):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_lines_as_splitlines(spark):
    r = random.Random(1)
    texts = ["", "a", "a\n", "\n", "a\r\nb", "a\r\n", "x\x0by\x0cz\x1c\x1d\x1e\x85q  "] + ["".join(r.choice("ab\n\r\x0b\x85  ") for _ in range(12)) for _ in range(200)]
    got = corpus.table(spark, list(enumerate(texts)), "k int, text string").select("k", tx.split_lines(F.col("text")).alias("l")).collect()
    assert {r.k: r.l for r in got} == {k: t.splitlines() for k, t in enumerate(texts)}


def test_patterns_as_in_python(spark):
    r = random.Random(2)
    parts = ["rm", " ", "-rf", "sudo", " ", "curl", "|", "bash", "POST", "http", "--yes", "-y", "skip", "tests", "user:", "root", "'", "privileged:", "true", "9000:9000", "ssh", "-R", "wget"]
    lines = [(k, "".join(r.choice(parts) for _ in range(r.randint(1, 9)))) for k in range(400)]
    table = rules.AGENT + rules.DOCKER
    got = {(r.k, r.rule_ord, r.matched) for r in rules.match_values(corpus.table(spark, lines, "k int, line_text string"), "line_text", table).collect()}
    assert got == {(k, i, m[0]) for k, x in lines for i, rule in enumerate(table) if (m := re.search(rule.pattern, x))} and len(got) > 100


@given(st.text("ab*?[]!./-", max_size=8))
@settings(max_examples=200, deadline=None)
def test_globs_as_fnmatch(glob):
    import fnmatch

    if re.search(r"\[[^\]]*[-!\[]", glob) or "[]" in glob or "[!]" in glob:
        return
    for path in ("a", "ab", "a/b", "*", "a.b", "a-", "[", "]", "!"):
        assert bool(re.search(tx.glob_regex(glob), path)) == fnmatch.fnmatchcase(path, glob)


def test_masks_ranks_and_shifts(spark):
    rows = [("12345678", "HIGH", "src/a"), ("123456789", "odd", "tests/a"), ("1" * 40, None, "chat/a"), ("", "CRITICAL", "chat/test"), (None, "INFO", "x_log/a")]
    got = corpus.table(spark, rows, "v string, s string, p string").select(tx.mask(F.col("v")), tx.rank(F.col("s")), tx.rank(F.col("s"), 5), tx.shifted(tx.rank(F.col("s")), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("****", 1, 1, 1), ("1234*6789", 4, 5, 4), ("1111" + "*" * 32 + "1111", 4, 4, 3), ("****", 0, 0, 0), ("****", 4, 4, 3)]


def test_ages(spark):
    times = {"m1s": "2026-01-01 00:00:01", "d0": "2026-01-01 00:00:00", "d29": "2025-12-03 00:00:00", "d30": "2025-12-02 00:00:00", "d89": "2025-10-04 00:00:00", "d90": "2025-10-03 00:00:00"}
    known = corpus.table(spark, [("PyPI", k, 200, v) for k, v in times.items()] + [("PyPI", "gone", 404, None)], "registry string, package string, http_status int, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    packages = corpus.table(spark, [("f", "PyPI", k, 1) for k in [*times, "gone", "unknown"]], "file string, registry string, package string, ord int")
    got = {r.package: r.severity for r in dependencies.check(packages, known, corpus.AS_OF).collect()}
    assert got == {"m1s": "HIGH", "d0": "HIGH", "d29": "HIGH", "d30": "MEDIUM", "d89": "MEDIUM", "gone": "CRITICAL"}


def test_manifests(spark):
    tree = corpus.files(spark, corpus.PACKAGE_FILES + [("x/package.json", "[1]"), ("y/package.json", ""), ("z/requirements.txt", " \tabc ==1\r\n-e .\n")])
    assert [r.package for r in dependencies.from_requirements(tree).orderBy("file", "ord").collect()] == ["requests", "flask", "ghostly-lib-77", "-r", "git", "requests", "pkg", "abc", "-e"]
    assert "-r" not in {r.package for r in dependencies.from_requirements(tree, strict=True).collect()}
    assert [r.package for r in dependencies.from_package_json(tree).orderBy("file", "ord").collect()] == ["jest", "react", "left-padder", "jest"]


def test_broken_cache_rows_are_left_out(spark):
    good = dependencies.sealed(corpus.cache(spark))
    bad = good.withColumn("severity", F.when(F.col("package") == "flask", "LOW").otherwise(F.col("severity")))
    assert {r.package for r in dependencies.unbroken(bad).collect()} == {"requests", "ghostly-lib-77", "react"}
    assert dependencies.unbroken(good.withColumn("integrity", F.lit(None).cast("string"))).count() == 4


def ignored(spark, paths, patterns, mode="compat", f=files.ignored):
    df = corpus.table(spark, [(p,) for p in paths], "p string")
    keep = f(F.col("p"), patterns, mode) if f is files.ignored else f(F.col("p"), patterns)
    return {r.p for r in df.where(keep).collect()}


def test_ignore_modes(spark):
    assert ignored(spark, ["./a.log", "b/c.log", "b/keep.log", "v/x", "w/v/x"], ["!keep.log", "*.log", "v/"]) == {"./a.log", "b/c.log", "v/x"}
    assert ignored(spark, ["a.log", "keep.log"], ["*.log", "!keep.log"]) == {"a.log", "keep.log"}
    assert ignored(spark, ["a.log", "keep.log", "v/x", "w/v/x", "v", "b/d.txt", "b/e/d.txt"], ["*.log", "!keep.log", "v/", "b/*.txt"], "gitignore") == {"a.log", "v/x", "w/v/x", "b/d.txt"}
    assert ignored(spark, ["d/a/b", "d/a", "e/a", "a"], ["d", "!d/a"], f=files.pruned) == {"d/a/b", "d/a"}
    assert ignored(spark, ["x"], []) == set()
    assert files.parse_ignore("# c\n\n a \n!b\n") == ["a", "!b"]


def test_containment(spark):
    df = corpus.table(spark, [("root/a",), ("root-evil/a",), ("root/../x",), ("root",)], "p string")
    assert [r.p for r in df.where(files.inside(F.col("p"), "root/")).collect()] == ["root/a"]


def chain(n):
    return "+".join(f"'{chr(97 + i % 26)}'" for i in range(n))


def test_ast_strings():
    s = ast_strings.strings
    assert s("'a'+'b'+x") == [(1, "ab", True)] and s("x+'a'+'b'") == [(1, "b", False), (1, "a", False)]
    assert s("f'q{x}'") == [(1, "q", False)] and s("'a' 'b'") == [(1, "ab", False)]
    assert s('"""doc"""\n1') == [(1, "doc", False)] and s("''+''") == [(1, "", False), (1, "", False)]
    assert len(s(chain(101))) == 1 and len(s(chain(101))[0][1]) == 101
    assert sorted(len(v) for _, v, _ in s(chain(103))) == [1, 1, 101]
    assert s("def (") == [] and s("\0") == [] and s("x = " + "(" * 5000) == []
    assert s("1 + 2") == [] and s("b'x'") == []


def test_text_issues_of_bytes(spark):
    raw = corpus.table(spark, queries._RAW, "file string, code string").select("file", F.unhex("code").alias("data"))
    assert sorted(map(tuple, layout.text_issues(raw, "file").collect())) == queries._ISSUES


def test_rewriting_twice_changes_nothing(spark):
    lines = tx.explode_lines(corpus.files(spark, corpus.BLOCK_FILES))
    once = blocks.rewrite(lines, block=corpus.NEW_BLOCK, **corpus.BLOCK)
    twice = blocks.rewrite(once, block=corpus.NEW_BLOCK, **corpus.BLOCK)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_findings_of_unknown_severity(spark):
    rows = [("a", "odd"), ("b", None), ("c", "LOW"), ("d", "CRITICAL")]
    df = findings.findings(corpus.table(spark, rows, "file string, severity string"), "secret", file="file", severity="severity")
    assert {r.file for r in findings.at_least(df, "INFO").collect()} == set("abcd")
    assert {r.file for r in findings.at_least(df, "LOW").collect()} == set("cd")
    assert [r.file for r in findings.ordered(df).collect()] == ["d", "c", "b", "a"]
    assert findings.exit_code(df.where("false")).first().exit_code == 0
    assert findings.titled(df).first().title == "Issue"


def tree(tmp_path):
    for name, text in corpus.DEMO_FILES + [(".hidden/_x.md", "AKIA" + "ABCDEFGH23456789")]:
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    (tmp_path / "big.txt").write_bytes(b"a" * (files.MOST_BYTES + 1))
    (tmp_path / "fits.txt").write_bytes(b"a" * files.MOST_BYTES)
    (tmp_path / "bad.txt").write_bytes(b"a\xffb\r\nc")
    os.symlink("/etc/hostname", tmp_path / "out.txt")
    return tmp_path


def test_source_lists_hidden_files_and_guards(spark, tmp_path):
    got = {r.file: r for r in read_repo(spark, str(tree(tmp_path)), per_task="2").collect()}
    assert {".agent/rules.md", ".hidden/_x.md", "big.txt", "chats/one.md"} <= set(got)
    assert got["big.txt"].text is None and len(got["fits.txt"].text) == files.MOST_BYTES and got["bad.txt"].text == "ab\nc" and got["out.txt"].text is None
    assert [r.file for r in read_repo(spark, str(tmp_path / "requirements.txt")).collect()] == ["requirements.txt"]
    assert not any(f.startswith(".agent/") for f in [r.file for r in read_repo(spark, str(tmp_path), prune=".agent").collect()])


def run(args):
    out = io.StringIO()
    with redirect_stdout(out):
        code = cli.main(args)
    return code, out.getvalue()


def test_command_line(spark, tmp_path):
    root = str(tree(tmp_path))
    os.remove(tmp_path / "fits.txt")
    code, out = run(["scan", root, "--format", "json", "--offline"])
    rows = json.loads(out)
    assert code == 1 and {r["check"] for r in rows} == {"secret", "agent_rule", "docker"} and any(r.get("file") == ".hidden/_x.md" for r in rows)
    assert all(None not in r.values() for r in rows)
    (tmp_path / cli.IGNORE_FILE).write_text("*\n")
    assert run(["scan", root, "--offline"])[0] == 0 and run(["scan", root, "--offline", "--no-ignore", "--severity", "CRITICAL", "--no-color"])[0] == 1
    assert run(["check-docker", str(tmp_path / "requirements.txt")]) == (0, "Nothing found.\n")
    assert run(["scan", str(tmp_path / "none")])[0] == 2
    code, out = run(["demo", "--no-color"])
    assert code == 0 and "Destructive command" in out and out.strip().splitlines()[-1].startswith("CRITICAL: ")


def test_packages_by_registry_and_cache(spark, tmp_path):
    root = str(tree(tmp_path))
    os.remove(tmp_path / "fits.txt")
    table = str(tmp_path.parent / f"{tmp_path.name}-registry")
    corpus.registry(spark).write.parquet(table)
    deps = ["check-deps", root, "--no-color"]
    assert run([*deps, "--offline"]) == (0, "Nothing found.\n")  # nothing is known of packages
    code, out = run([*deps, "--registry", table, "--as-of", corpus.AS_OF])
    assert code == 1 and "ghostly-lib-77" in out and "flask" in out
    assert run([*deps, "--offline", "--as-of", "2026-01-09 00:00:00"])[1].count("ghostly-lib-77") == 1  # from the cache, however old
    with answering({}) as urls:  # too old, and registries that fail say nothing
        assert run([*deps, "--as-of", "2026-01-09 00:00:00", *urls]) == (0, "Nothing found.\n")
    other = tmp_path / "kept"
    other.mkdir()
    assert run(["cache-clear", str(other)])[0] == 0 and other.exists()
    assert run(["cache-clear", root])[0] == 0 and not (tmp_path / cli.CACHE_DIR).exists() and (tmp_path / "requirements.txt").exists()


@contextmanager
def answering(bodies):
    """A registry on this machine: 200 with a body, 404 where that is None, 500 for other paths."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = bodies.get(self.path, 500)
            self.send_response(404 if body is None else body if isinstance(body, int) else 200)
            self.end_headers()
            self.wfile.write(body.encode() if isinstance(body, str) else b"")

        def log_message(self, *_):
            pass

    asked = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    yield ["--pypi-url", at + "/pypi/{}/json", "--npm-url", at + "/npm/{}"]
    server.shutdown()
    assert len(asked) == len(set(asked)) and asked


def test_packages_are_asked_for(spark, tmp_path):
    (tmp_path / "requirements.txt").write_text("old-one\nnew-one>=1\nghost\nodd\nold-one\n")
    (tmp_path / "package.json").write_text('{"dependencies": {"@a/b": "1"}}')
    upload = lambda day: json.dumps({"releases": {"1": [{"upload_time": f"{day}T00:00:00"}]}})
    bodies = {"/pypi/old-one/json": upload("2019-01-01"), "/pypi/new-one/json": upload("2025-12-20"), "/pypi/ghost/json": None, "/npm/@a%2Fb": json.dumps({"time": {"created": "2025-11-01T00:00:00.000Z"}})}
    with answering(bodies) as urls:
        code, out = run(["check-deps", str(tmp_path), "--format", "json", "--as-of", corpus.AS_OF, *urls])
    assert code == 1 and {(r["package"], r["severity"]) for r in json.loads(out)} == {("ghost", "CRITICAL"), ("new-one", "HIGH"), ("@a/b", "MEDIUM")}
    assert (tmp_path / cli.CACHE_DIR / cli.MARKER).exists()
    code, again = run(["check-deps", str(tmp_path), "--format", "json", "--as-of", corpus.AS_OF, "--offline"])
    assert (code, json.loads(again)) == (1, json.loads(out))


def test_rules_of_the_user_and_the_gate(spark, tmp_path):
    root = str(tree(tmp_path))
    os.remove(tmp_path / "fits.txt")
    (tmp_path / "rules.json").write_text(json.dumps([{"name": "First", "pattern": "^Ask", "severity": "CRITICAL", "remediation": "don't"}, {"name": "Broken", "pattern": "("}]))
    code, out = run(["check-rules", root, "--agent-rules", str(tmp_path / "rules.json"), "--format", "json"])
    assert code == 1 and [(r["rule_name"], r["line"], r["remediation"]) for r in json.loads(out)] == [("First", 3, "don't")]
    assert run(["gate", root, "--no-color", "--offline"])[0] == 1 and run(["install-hook", root])[0] == 2
    (tmp_path / ".git").mkdir()
    assert run(["install-hook", root])[0] == 0 and os.access(tmp_path / ".git/hooks/pre-commit", os.X_OK)


def test_patterns_that_look_at_their_place_and_bad_ones(spark):
    table = tuple(rules.Rule(p, p, "HIGH") for p in ("^secret", "secret$", "(?<=x)secret", r"\Asecret", "[^a]secret", "("))
    found = rules.match_files(corpus.files(spark, [("a", "first\nsecret here"), ("b", "a\nmy xsecret\nb")]), table)
    assert {(r.file, r.line, r.rule_name) for r in found.collect()} == {("a", 2, "^secret"), ("a", 2, r"\Asecret"), ("b", 2, "secret$"), ("b", 2, "(?<=x)secret"), ("b", 2, "[^a]secret")}
    assert rules.match_values(corpus.table(spark, [("secret",)], "value string"), "value", ()).count() == 0


def test_one_pass_gives_what_the_scans_give(spark):
    everything = spark.createDataFrame([r for rows in (corpus.CHAT_FILES, corpus.AGENT_FILES, corpus.DOCKER_FILES, corpus.PACKAGE_FILES, corpus.PYTHON_FILES) for r in rows] + [(None, "x"), ("a.md", None)], "file string, text string")
    for severity in ("INFO", "HIGH"):
        how = scans.Scan(registry=corpus.registry(spark), as_of=corpus.AS_OF, severity=severity, patterns=["deploy/*"])
        parts = [scan(everything, how) for scan in (scans.scan_dependencies, scans.scan_secrets, scans.scan_agent_rules, scans.scan_docker)]
        assert sorted(map(str, scans.full_scan(everything, how).collect())) == sorted(map(str, findings.union(*parts).collect())) and parts[1].count()
    plan = scans.full_scan(everything, how)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [file") + plan.count("LocalRelation [file") == 1 and "Card number" not in plan


def test_ignored_directories_are_not_entered(spark, tmp_path):
    root = str(tree(tmp_path))
    assert {r.file for r in read_repo(spark, root, ignore="chats\n!.agent\n.*\n").collect()} >= {".agent/rules.md", "requirements.txt"}
    assert not any(r.file.startswith(("chats/", ".hidden/")) for r in read_repo(spark, root, ignore="chats\n!.agent\n.*\n").collect())
    beside = tmp_path.parent / f"{tmp_path.name}-evil"
    beside.mkdir()
    (beside / "x.txt").write_text("x")
    os.symlink(beside / "x.txt", tmp_path / "link.txt")
    assert [r.text for r in read_repo(spark, root).where("file = 'link.txt'").collect()] == [None]


def test_manifest_by_patterns_and_an_audit(spark):
    manifest = corpus.table(spark, [(1, "pattern", ".agent/rules.md", "(?i)ASK FIRST", "a"), (2, "unlike", ".agent/rules.md", "(?i)drop +table", "b"), (3, "pattern", "none.md", "x", "c"), (4, "unlike", "none.md", "x", "d")], "check_id int, kind string, path string, literal string, message string")
    assert sorted(r.check_id for r in layout.violations(corpus.files(spark, corpus.AGENT_FILES), manifest).collect()) == [2, 3]


def test_long_words_take_linear_time(spark):
    long = corpus.files(spark, [("a.txt", "a" * 2_000_000 + " x@y.org"), ("b.txt", "-----BEGIN " + "A " * 100_000), ("c.txt", "a@" + "b." * 500_000)])
    assert {r.file for r in rules.match_files(long, scans.ALL_SECRETS).collect()} >= {"a.txt"}


def test_colours(spark):
    found = scans.scan_docker(corpus.demo(spark))
    assert "\033[" in report.console(found, True) and "\033[" not in report.console(found)


def test_stream_scans_each_document_once(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    key = "AKIA" + "ABCDEFGH23456789"
    for k in range(2):
        corpus.table(spark, [(k, f"x\n{key}"), (10 + k, "clean")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        assert scan_new(spark, source, "doc_id long, text string", sink, checkpoint).awaitTermination(120)
        assert sorted((r.file, r.line) for r in spark.read.parquet(sink).collect()) == [(str(i), 2) for i in range(k + 1)]


def test_rows_with_nulls_and_empty_tables(spark):
    odd = corpus.files(spark, [("a.md", None), (None, "AKIA" + "ABCDEFGH23456789"), ("b.md", ""), (None, None)])
    for scan in (scans.scan_secrets, scans.scan_agent_rules, scans.scan_docker, scans.scan_dependencies, scans.full_scan):
        assert scan(odd).count() == 0 and scan(odd.where("false")).count() == 0
    assert rules.match_files(odd, rules.SECRETS).count() == 1
