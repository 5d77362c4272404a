import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from repolens.functions.paths import globs_column_to_regex, globs_to_regex
from repolens.operators.commits import author_metrics, churn_by_repo
from repolens.operators.findings import security_line_hits
from repolens.operators.settings import allowed_hits, drop_excluded, in_own_period, repo_months
from repolens.plans.author_report import smell_scan
from repolens.rules import SMELL, SMELL_RULES
from repolens.sources.config import merged_settings, read_ignore_files, read_settings

SETTINGS = "repo_id STRING, since DATE, exclude ARRAY<STRING>, disabled ARRAY<STRING>, language STRING"
GLOBS = ["legacy/**", "vendor/*", "*.min.js", "**/secret.xml", "a?c/", "./x.ts", "", "  ", "b[1].ts", "$^.(|)+{}", "dir\\sub/*.ts", "**", "a**b"]


def settings(spark, *rows):
    return spark.createDataFrame([(r, None if s is None else date.fromisoformat(s), e, d, x) for r, s, e, d, x in rows], SETTINGS)


@pytest.mark.parametrize("globs", [[g] for g in GLOBS] + [GLOBS, GLOBS + GLOBS, []])
def test_a_column_of_globs_gives_the_regex_of_the_list(spark, globs):
    row = spark.createDataFrame([(globs,)], "g ARRAY<STRING>").select(globs_column_to_regex(F.col("g")).alias("r")).first()
    assert row["r"] == globs_to_regex(globs)


def test_null_globs_exclude_nothing(spark):
    rows = spark.createDataFrame([(None,), ([None, " "],)], "g ARRAY<STRING>").select(globs_column_to_regex(F.col("g")).alias("r")).collect()
    assert [r["r"] for r in rows] == [None, None]


def test_each_repository_excludes_its_own_paths(spark):
    rows = spark.createDataFrame(
        [(r, p) for r in "abcd" for p in ("legacy/x.ts", "./vendor/y.js", "src\\gen\\z.ts", None)], "repo_id STRING, path STRING")
    own = settings(
        spark, ("a", None, ["legacy/**"], [], None), ("b", None, ["vendor/*", "src/gen"], [], None), ("c", None, [], [], None))
    got = sorted((r["repo_id"], r["path"] or "") for r in drop_excluded(rows, own).collect())
    every = {"legacy/x.ts", "./vendor/y.js", "src\\gen\\z.ts", ""}
    assert got == sorted([("a", p) for p in every - {"legacy/x.ts"}] + [("b", p) for p in ("legacy/x.ts", "")] + [(r, p) for r in "cd" for p in every])


def test_churn_of_three_repositories(spark, commits):
    made = None
    for repo in "abc":
        one = commits([("s1", "Ann", "ann@ex.com", "2026-01-05", "x")], repo=repo)
        made = one if made is None else made.unionByName(one)
    files = spark.createDataFrame(
        [(r, "s1", p, n, 1) for r in "abc" for p, n in (("legacy/big.ts", 1000), ("src/a.ts", 10))],
        "repo_id STRING, sha STRING, path STRING, added INT, deleted INT")
    own = settings(spark, ("a", None, ["legacy/**"], [], None), ("b", None, ["src/*"], [], None))
    got = {r["repo_id"]: r["added"] for r in churn_by_repo(made, files, own).collect()}
    assert got == {"a": 10, "b": 1000, "c": 1010}


def by_month(spark, rows, path):
    table = rows.withColumn("commit_month", F.date_format("commit_ts", "yyyy-MM"))
    table.write.partitionBy("commit_month").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def test_each_repository_has_its_own_start(spark, commits, tmp_path):
    rows = [(f"s{m}", "Ann", "ann@ex.com", f"2026-{m:02d}-10", "x") for m in range(1, 13)]
    made = commits(rows, repo="a").unionByName(commits(rows, repo="b")).unionByName(commits(rows, repo="c"))
    own = settings(spark, ("a", "2026-03-10", [], [], None), ("b", "2026-11-11", [], [], None), ("c", None, [], [], None))
    stored = by_month(spark, made, str(tmp_path / "commits"))
    for table in made, stored:
        got = {r["repo_id"]: r["commits"] for r in author_metrics(in_own_period(table, own)).collect()}
        assert got == {"a": 10, "b": 1, "c": 12}
        assert in_own_period(table, own).columns == table.columns


def test_months_nobody_asks_for_are_not_read(spark, commits, tmp_path):
    rows = [(f"s{m}", "Ann", "ann@ex.com", f"2026-{m:02d}-10", "x") for m in range(1, 13)]
    stored = by_month(spark, commits(rows, repo="a").unionByName(commits(rows, repo="b")), str(tmp_path / "commits"))
    found = in_own_period(stored, settings(spark, ("a", "2026-10-01", [], [], None), ("b", "2026-12-01", [], [], None)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert found.count() == 4


def test_months_of_a_repository(spark):
    own = settings(spark, ("a", "2026-02-20", [], [], None), ("b", "2027-01-01", [], [], None))
    assert [(r["repo_id"], r["commit_month"]) for r in repo_months(own, "2026-04-30").orderBy("commit_month").collect()] == [
        ("a", "2026-02"), ("a", "2026-03"), ("a", "2026-04")]


CODE = "const a: any = 1;\nconsole.log(a);\n// TODO\n"


def test_hits_follow_the_settings(spark, tree, tmp_path):
    made = [tree({"src/a.ts": CODE, "legacy/b.ts": CODE, "C.java": "// TODO\ne.printStackTrace();\n", "d.py": "# TODO\n"}, repo=r) for r in "wxyz"]
    files, blame = made[0]
    for f, b in made[1:]:
        files, blame = files.unionByName(f), blame.unionByName(b)
    own = settings(
        spark, ("w", None, ["legacy/"], ["any"], None), ("x", None, [], [], "java"), ("y", None, [], [], "cobol"))
    got = {}
    for r in smell_scan(files, blame, settings=own, store=str(tmp_path / "scan")).hits.collect():
        got.setdefault(r["repo_id"], set()).add((r["path"], r["rule_id"]))
    every = {("src/a.ts", k) for k in ("any", "console", "todo")} | {("legacy/b.ts", k) for k in ("any", "console", "todo")} | {
        ("C.java", "todo"), ("C.java", "stacktrace"), ("d.py", "todo")}
    assert got == {
        "w": {h for h in every if not h[0].startswith("legacy") and h[1] != "any"}, "x": {("C.java", "todo"), ("C.java", "stacktrace")},
        "y": every, "z": every}


def test_one_list_for_all_is_the_scan_with_that_list(spark, tree, tmp_path):
    files, blame = tree({"src/a.ts": CODE * 90, "legacy/b.ts": CODE, "C.java": "// TODO\n", "t.html": "<img src='a'>\n"})
    own = settings(spark, ("r", None, ["legacy/**"], ["nonnull", "large"], None))
    a = smell_scan(files, blame, settings=own, store=str(tmp_path / "own"))
    b = smell_scan(files, blame, exclude=["legacy/**"], disabled=["nonnull", "large"])
    for name in "counts", "owned", "grades":
        assert sorted(map(str, getattr(a, name).collect())) == sorted(map(str, getattr(b, name).collect())), name


def test_security_hits_follow_the_settings(spark, tree):
    code = {"a.ts": "el.innerHTML = x;\neval(x);\n", "b/c.env": "API_KEY=abcdef1234567890xyz\n"}
    made = [tree(code, repo=r) for r in "abc"]
    files = made[0][0].unionByName(made[1][0]).unionByName(made[2][0])
    own = settings(spark, ("a", None, ["b/**"], ["xss-eval"], None), ("b", None, [], [], "java"))
    plain = {(r["repo_id"], r["path"], r["rule_id"]) for r in security_line_hits(files).collect()}
    got = {(r["repo_id"], r["path"], r["rule_id"]) for r in security_line_hits(files, settings=own).collect()}
    assert {h for h in plain if h[0] == "c"} == {h for h in got if h[0] == "c"}
    assert {h for h in got if h[0] == "a"} == {h for h in plain if h[0] == "a" and h[1] == "a.ts" and h[2] != "xss-eval"}
    assert {h[1] for h in got if h[0] == "b"} <= {"b/c.env"}


def test_settings_and_ignore_files_of_many_repositories(spark, tmp_path):
    for repo, config in {
        "one": {"period": {"start": "2026-01-01"}, "excludePaths": ["legacy/**"], "disabledRules": ["any"], "language": "java"},
        "two": {"period": {"start": "soon"}}, "three": {},
    }.items():
        (tmp_path / "config" / repo).mkdir(parents=True)
        (tmp_path / "config" / repo / "report.json").write_text(json.dumps(config))
    (tmp_path / "ignore" / "two").mkdir(parents=True)
    (tmp_path / "ignore" / "two" / "ignore.txt").write_text("# vendored\n\n  vendor/* \nlegacy/**\n")
    repos = spark.createDataFrame([("one",), ("two",), ("three",), ("four",)], "repo_id STRING")
    out = merged_settings(
        repos, read_settings(spark, str(tmp_path / "config")), read_ignore_files(spark, str(tmp_path / "ignore")), exclude=["vendor/*"], disabled=["any"])
    got = {r["repo_id"]: (str(r["since"]), r["exclude"], r["disabled"], r["language"]) for r in out.collect()}
    assert got == {
        "one": ("2026-01-01", ["legacy/**", "vendor/*"], ["any"], "java"), "two": ("None", ["legacy/**", "vendor/*"], ["any"], None),
        "three": ("None", ["vendor/*"], ["any"], None), "four": ("None", ["vendor/*"], ["any"], None)}


def test_no_settings_and_no_rows(spark, tree):
    files, _ = tree({"a.ts": CODE})
    none = settings(spark)
    assert drop_excluded(files, none).count() == 1
    hits = spark.createDataFrame([("r", "a.ts", "todo", 1)], "repo_id STRING, path STRING, rule_id STRING, line_no INT")
    assert allowed_hits(hits, none, SMELL_RULES, SMELL).collect() == hits.collect()
    assert allowed_hits(hits.limit(0), none, [], SMELL).count() == 0
