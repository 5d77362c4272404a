import datetime
import itertools
import random

from pyspark.sql import functions as F

from repolens.operators import cadence
from repolens.operators.authors import (
    contained_keys,
    dedupe_roster,
    match_author_contains,
    missing_authors,
    missing_summary,
)
from repolens.operators.commits import (
    author_metrics,
    commits_since,
    date_bounds,
    discover_authors,
    line_churn,
    monthly_cadence,
    months_map,
)
from repolens.operators.scoring import final_grades
from repolens.plans.delta_report import build_snapshot, delta_report
from repolens.sources.config import roster_from_authors
from repolens.sources.snapshots import latest_snapshot, read_snapshots, write_snapshot

LOG = [
    ("a1", "Al", "AL@ex.com", "2025-12-30", "feat: x"), ("a2", "Al", "al@ex.com", "2026-01-05", "fix: y ABC-1"),
    ("a3", "Albert", "al@ex.com", "2026-01-06", "stuff"), ("b1", "Bo", "bo@ex.com", "2026-02-01", "docs: z #3"),
]
FILES = "repo_id STRING, sha STRING, path STRING, added INT, deleted INT"
ROSTER = ("repo_id STRING, position INT, email STRING, name STRING, short STRING, git_grade STRING, code_grade STRING, "
          "hide_from_cards BOOLEAN")


def roster(spark, *emails, grade=""):
    return spark.createDataFrame([("r", i, e, f"N{i}", f"n{i}", grade, "", False) for i, e in enumerate(emails)], ROSTER)


def test_discover_authors(commits):
    got = {r.email: (r.name, r.commits) for r in discover_authors(commits(LOG)).collect()}
    assert got == {"al@ex.com": ("Al", 3), "bo@ex.com": ("Bo", 1)}  # tie: first name in order


def test_metrics_and_period(commits):
    al = author_metrics(commits(LOG)).filter("email = 'al@ex.com'").first()
    assert (al.commits, al.conv, al.tickets, al.conv_pct, al.ticket_pct) == (3, 2, 1, 67, 33)
    assert al.last_active == datetime.date(2026, 1, 6)
    assert author_metrics(commits(LOG), "2026-01-06").count() == 2
    assert author_metrics(commits(LOG), "2030-01-01").count() == 0
    bounds = date_bounds(commits(LOG)).first()
    assert (bounds.first_date, bounds.through_date) == (datetime.date(2025, 12, 30), datetime.date(2026, 2, 1))


def test_last_active_is_the_author_day_of_the_latest_commit(spark):
    df = spark.createDataFrame(
        [("r", "1", "A", "a@x", "1965-03-04", "1970-01-02 00:00:00", "s"), ("r", "2", "A", "a@x", "1990-03-04", "1960-01-01 00:00:00", "s")],
        "repo_id STRING, sha STRING, author_name STRING, author_email STRING, d STRING, t STRING, subject STRING")
    df = df.withColumn("author_date", F.to_date("d")).withColumn("commit_ts", F.to_timestamp("t"))
    assert author_metrics(df).first().last_active == datetime.date(1965, 3, 4)


def test_churn_and_exclusions(spark, commits):
    files = spark.createDataFrame([
        ("r", "a1", "app.ts", 10, 1), ("r", "a1", "legacy/Old.java", 1000, 0), ("r", "a2", "img.png", None, None)], FILES)
    total = lambda **k: {r.email: (r.added, r.deleted) for r in line_churn(commits(LOG), files, **k).collect()}
    assert total() == {"al@ex.com": (1010, 1), "bo@ex.com": (0, 0)}
    assert total(exclude=["legacy/**"]) == {"al@ex.com": (10, 1), "bo@ex.com": (0, 0)}
    assert total(since="2030-01-01") == {}


def test_cadence(commits):
    long = monthly_cadence(commits(LOG))
    heat = cadence.month_heatmap(long, date_bounds(commits(LOG)))
    assert {(r.email, r.label, r.commits) for r in heat.collect()} == {
        ("al@ex.com", "Dec '25", 1), ("al@ex.com", "Jan", 2), ("bo@ex.com", "Feb", 1)}
    assert {r.email: r.cadence for r in cadence.cadence_text(heat).collect()} == {
        "al@ex.com": "Dec '25 1 / Jan 2", "bo@ex.com": "Feb 1"}
    assert months_map(long).filter("email = 'al@ex.com'").first().months == {"2025-12": 1, "2026-01": 2}
    many = commits([(f"m{i}", "A", "a@x", f"2026-0{i}-01", "s") for i in range(1, 9)])
    wide = cadence.heatmap_wide(cadence.month_heatmap(monthly_cadence(many), date_bounds(many))).first()
    assert [wide[f"month_{i}"] for i in range(1, 7)] == [1] * 6
    bars = {r.email: r.share for r in cadence.commit_bars(author_metrics(commits(LOG))).collect()}
    assert bars == {"al@ex.com": 100.0, "bo@ex.com": 33.3}


def test_roster_is_deduplicated(spark):
    got = dedupe_roster(roster(spark, "B@x", " b@X ", "", "a@x", None)).orderBy("position").collect()
    assert [(r.email, r.name) for r in got] == [("b@x", "N0"), ("a@x", "N3")]


def test_missing_authors(spark, commits):
    rows = [(f"c{i}", n, e, "2026-01-01", "s") for i, (n, e) in enumerate(
        [("Alice", "alice@ex.com"), ("Bob", "bob@ex.com"), ("Eve", "eve@ex.com"), ("Dan", "d@ex.co")])]
    authors = discover_authors(commits(rows))
    missing = missing_authors(authors, roster(spark, "alice@ex.com", "eve@", "dd@ex.com"))
    assert [r.email for r in missing.collect()] == ["bob@ex.com"]  # d@ex.co is a part of dd@ex.com
    top = missing_summary(missing_authors(authors, roster(spark, "nobody@y")), top=1).first()
    assert (top.email, top.n_missing, top.n_more) == ("alice@ex.com", 4, 3)


def test_contained_keys_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab@") for _ in range(rng.randint(1, n)))
    texts, keys = {word(9) for _ in range(60)}, {word(4) for _ in range(40)}
    got = contained_keys(spark.createDataFrame([("r", t) for t in texts], "repo_id STRING, text STRING"),
                         spark.createDataFrame([("r", k) for k in keys], "repo_id STRING, key STRING"))
    assert sorted((r.text, r.key) for r in got.collect()) == sorted((t, k) for t, k in itertools.product(texts, keys) if k in t)


def test_loose_author_matching(spark, commits):
    got = match_author_contains(commits(LOG), roster(spark, "@ex.com", "Al", "nobody"))
    assert {r.email: r.commits for r in got.collect()} == {"@ex.com": 4, "Al": 3}


def test_grades_set_by_hand_win(spark, commits):
    people = dedupe_roster(roster(spark, "al@ex.com", grade="C").union(roster(spark, "x@y")))
    got = {r.email: (r.git_grade, r.auto_git, r.code_grade, r.auto_code) for r in final_grades(people, author_metrics(commits(LOG)), None).collect()}
    assert got == {"al@ex.com": ("C", False, None, False), "x@y": ("D", True, None, False)}


def test_delta_and_snapshots(spark, commits, tmp_path):
    path = str(tmp_path / "snap")
    files = spark.createDataFrame([("r", "a1", "app.ts", 10, 1)], FILES)
    first = commits(LOG[:2])
    for _ in range(2):  # a repeated write replaces itself
        write_snapshot(build_snapshot(first, files), path, build="one")
    write_snapshot(build_snapshot(commits(LOG[:1], repo="other"), files), path, build="two")
    stored = read_snapshots(spark, path)
    assert stored.count() == 2
    row = latest_snapshot(stored).filter("repo_id = 'r'").first()
    assert (row.commits, row.added, row.compiled_date, row.previous_compiled_date) == (
        2, 10, datetime.date(2026, 1, 5), datetime.date(2025, 12, 30))
    report = {r.email: (r.since, r.vs_snapshot) for r in delta_report(
        commits(LOG), roster(spark, "al@ex.com", "bo@ex.com"), stored).collect()}
    assert report == {"al@ex.com": (2, 1), "bo@ex.com": (1, None)}  # the last compiled day counts again
    full = delta_report(commits(LOG), roster(spark, "al@ex.com"), None).first()
    assert (full.since, full.vs_snapshot, full.grades) == (3, None, "C+*/—")


def test_commits_since_is_inclusive(spark, commits):
    start = spark.createDataFrame([("r", datetime.date(2026, 1, 5))], "repo_id STRING, last_date DATE")
    assert {r.email: r.since for r in commits_since(commits(LOG), start).collect()} == {"al@ex.com": 2, "bo@ex.com": 1}


def test_roster_without_configuration(commits):
    got = roster_from_authors(discover_authors(commits(LOG))).orderBy("position", "email").collect()
    assert [(r.email, r.short, r.git_grade) for r in got] == [("al@ex.com", "Al", ""), ("bo@ex.com", "Bo", "")]
