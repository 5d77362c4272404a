import datetime

import pytest

from repolens.operators.languages import explicit_packs
import repolens.plans.build as build_module
from repolens.plans.build import Inputs, Options, build
from repolens.sources.snapshots import latest_snapshot, read_snapshots
from tests.test_commits import FILES, LOG


def test_explicit_language():
    assert explicit_packs("java") == ["java"] and explicit_packs("cobol") is None and explicit_packs(None) is None


def test_two_builds(spark, tree, commits, tmp_path):
    files, blame = tree({"a.ts": "x as any\neval(x)\n", "legacy/b.ts": "eval(x)\n"}, author=("Al", "AL@ex.com"))
    churn = spark.createDataFrame([("r", "a1", "a.ts", 10, 1), ("r", "a1", "legacy/b.ts", 5, 0)], FILES)
    snap = str(tmp_path / "snap")
    options = Options(exclude=["legacy/**"])

    first = Inputs(commits(LOG[:2]), churn, files, blame)
    names = build(first, str(tmp_path / "one"), options=options, snapshot_path=snap, build_id="one")
    read = lambda folder, name: spark.read.parquet(str(tmp_path / folder / name))
    assert {"authors", "delta", "issue_matrix", "heatmap", "security/top", "missing_authors"} <= set(names)
    al = read("one", "authors").first()
    assert (al.email, al.commits, al.added, al.score, al.lines_owned, al.code_grade) == ("al@ex.com", 2, 10, 2, 2, "B+")
    assert read("one", "findings").first().rule_id == "xss-eval" and read("one", "findings").count() == 1
    assert read("one", "missing_authors").count() == 0

    hand = spark.createDataFrame([("r", 0, "Layout", "Al", "7 pages")], "repo_id STRING, position INT, label STRING, short STRING, cell STRING")
    second = Inputs(commits(LOG), churn, files, blame, snapshots=read_snapshots(spark, snap), matrix_by_hand=hand)
    build(second, str(tmp_path / "two"), options=options, snapshot_path=snap, build_id="two")
    delta = {r.email: (r.since, r.vs_snapshot) for r in read("two", "delta").collect()}
    assert delta == {"al@ex.com": (2, 1), "bo@ex.com": (1, None)}
    assert [(r.label, r.cell, r.intensity) for r in read("two", "issue_matrix").collect()] == [("Layout", "7 pages", 0.15)]
    row = latest_snapshot(read_snapshots(spark, snap)).filter("email = 'al@ex.com'").first()
    assert (row.commits, row.compiled_date, row.previous_compiled_date) == (3, datetime.date(2026, 2, 1), datetime.date(2026, 1, 5))


def test_build_without_scans(spark, tree, commits, tmp_path):
    files, blame = tree({"a.ts": ""})
    churn = spark.createDataFrame([], FILES)
    names = build(Inputs(commits(LOG), churn, files, blame), str(tmp_path / "b"), options=Options(scan_smells=False, scan_security=False))
    assert "issue_matrix" not in names
    assert {r.code_grade for r in spark.read.parquet(str(tmp_path / "b" / "authors")).collect()} == {None}


def test_a_build_over_the_same_tables_computes_no_stage_again(spark, tree, commits, tmp_path):
    files, blame = tree({"a.ts": "x as any\n", "legacy/b.ts": "eval(x)\nx as any\n"}, author=("Al", "AL@ex.com"))
    churn = spark.createDataFrame([("r", "a1", "a.ts", 10, 1), ("r", "a1", "legacy/b.ts", 5, 0)], FILES)
    stored = {}
    for name, table in {"commits": commits(LOG), "churn": churn, "files": files, "blame": blame}.items():
        table.write.parquet(str(tmp_path / "in" / name))
        stored[name] = spark.read.parquet(str(tmp_path / "in" / name))
    own = spark.createDataFrame(
        [("r", datetime.date(2025, 12, 1), ["legacy/**"], ["large"], None)],
        "repo_id STRING, since DATE, exclude ARRAY<STRING>, disabled ARRAY<STRING>, language STRING")
    own.write.parquet(str(tmp_path / "in" / "settings"))
    inputs = Inputs(stored["commits"], stored["churn"], stored["files"], stored["blame"], settings=spark.read.parquet(str(tmp_path / "in" / "settings")))
    seen = []

    class Seen(build_module.Stages):
        def __init__(self, *args):
            super().__init__(*args)
            seen.append(self)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(build_module, "Stages", Seen)
        build(inputs, str(tmp_path / "out"))
        before = sorted(map(str, spark.read.parquet(str(tmp_path / "out" / "authors")).collect()))
        build(inputs, str(tmp_path / "out"))
    assert {"metrics", "churn", "bounds", "months"} <= set(seen[0].computed) and len(seen[0].computed) == len(set(seen[0].computed))
    assert not {"metrics", "churn", "bounds", "months", "discovered"} & set(seen[1].computed)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out" / "authors")).collect())) == before
    al = [r for r in spark.read.parquet(str(tmp_path / "out" / "authors")).collect() if r.email == "al@ex.com"][0]
    assert (al.added, al.score) == (10, 2)
    assert not list((tmp_path / "out" / "findings").rglob("*.parquet"))  # the only finding is below an excluded path
