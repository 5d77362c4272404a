import datetime
import json

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from repolens.operators.commits import author_metrics
from repolens.sources.files import read_file_bytes, readable
from repolens.sources.config import read_ignore_patterns, read_roster, write_roster
from repolens.sources.feeds import read_gitleaks_json, read_semgrep_json
from repolens.sources.git_export import read_blame, read_commit_log, read_files, read_numstat
from repolens.sources.snapshots import latest_snapshot, read_snapshots
from repolens.sources.tables import write_by_month
from repolens.streaming.feeds import current_metrics, distinct_commits, monthly_metrics, read_commit_stream, stream_author_metrics, stream_snapshots
from workload import staging

LOG = (
    "\x1eabc\x1fAnn Lee\x1fAnn@x.org\x1f2026-01-31T23:30:00-05:00\x1f2026-02-01T04:30:00+00:00\x1ffeat: x\n\n"
    "3\t1\tsrc/a.ts\n-\t-\timg.png\n10\t0\tdir/with space.md\n"
    "\x1edef\x1fBo\x1fbo@x.org\x1f2026-02-02T00:00:00Z\x1f2026-02-02T00:00:00Z\x1fmerge\n"
    "\x1eabc\x1fAnn Lee\x1fAnn@x.org\x1f2026-01-31T23:30:00-05:00\x1f2026-02-01T04:30:00+00:00\x1ffeat: x"
)


def test_commit_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(LOG)
    log = read_commit_log(spark, str(tmp_path / "log.txt"), "r").orderBy("sha").collect()
    assert [(r.sha, r.author_name, r.author_email, r.author_date, r.subject) for r in log] == [
        ("abc", "Ann Lee", "Ann@x.org", datetime.date(2026, 1, 31), "feat: x"),
        ("def", "Bo", "bo@x.org", datetime.date(2026, 2, 2), "merge")]
    stat = read_numstat(spark, str(tmp_path / "log.txt"), "r").collect()
    assert sorted((r.sha, r.path, r.added, r.deleted) for r in stat if r.path != "img.png") == [
        ("abc", "dir/with space.md", 10, 0), ("abc", "src/a.ts", 3, 1)]
    assert [(r.added, r.deleted) for r in stat if r.path == "img.png"] == [(None, None)]


def test_files_and_blame(spark, tmp_path):
    (tmp_path / "src" / "d").mkdir(parents=True)
    (tmp_path / "src" / "d" / "a b.ts").write_text("one\ntwo\n")
    (tmp_path / "src" / "c+d.py").write_text("x")
    got = {r.path: r.content for r in read_files(spark, str(tmp_path / "src"), "r").collect()}
    assert got == {"d/a b.ts": "one\ntwo\n", "c+d.py": "x"}
    (tmp_path / "blame").mkdir()
    (tmp_path / "blame" / "a.ts").write_text(
        "s1 1 1 1\nauthor Ann\nauthor-mail <Ann@x>\nauthor-time 1\n\tauthor-mail <fake@x>\n"
        "s2 2 2 1\nauthor Bo Lee\nauthor-mail <bo@x>\nsummary author x\n\t\n")
    rows = read_blame(spark, str(tmp_path / "blame"), "r").orderBy("line_no").collect()
    assert [(r.path, r.line_no, r.author_name, r.author_email) for r in rows] == [
        ("a.ts", 1, "Ann", "Ann@x"), ("a.ts", 2, "Bo Lee", "bo@x")]


@pytest.mark.parametrize("root", ["repo/repo", "my dir", "a+b", "plain", "tail/"])
def test_paths_below_any_root(spark, tmp_path, root):
    below = tmp_path / root.rstrip("/") / "src" / root.rstrip("/").split("/")[-1]
    below.mkdir(parents=True)
    (below / "a b+c%20.ts").write_text("x")
    path = f"src/{below.name}/a b+c%20.ts"
    assert [(r.repo_id, r.path) for r in read_files(spark, f"{tmp_path}/{root}", "r").collect()] == [("r", path)]


def test_many_repositories_in_one_read(spark, tmp_path):
    for repo in ("one", "two w", "three"):
        (tmp_path / "code" / repo / "lib").mkdir(parents=True)
        (tmp_path / "code" / repo / "lib" / "m.py").write_text(f"# {repo}\n")
        (tmp_path / "blame" / repo / "lib").mkdir(parents=True)
        (tmp_path / "blame" / repo / "lib" / "m.py").write_text(f"s 1 1\nauthor {repo}\nauthor-mail <{repo[0]}@x>\n\t# {repo}\n")
    files = read_files(spark, str(tmp_path / "code")).collect()
    assert sorted((r.repo_id, r.path, r.content) for r in files) == [
        (repo, "lib/m.py", f"# {repo}\n") for repo in ("one", "three", "two w")]
    blame = read_blame(spark, str(tmp_path / "blame")).collect()
    assert sorted((r.repo_id, r.path, r.author_name) for r in blame) == [
        (repo, "lib/m.py", repo) for repo in ("one", "three", "two w")]


def test_reports_of_many_repositories(spark, tmp_path):
    for repo in ("one", "two"):
        (tmp_path / "secrets" / repo).mkdir(parents=True)
        (tmp_path / "secrets" / repo / "r.json").write_text(json.dumps([{"RuleID": repo, "File": "f", "StartLine": 1}]))
        (tmp_path / "sast").mkdir(exist_ok=True)
        (tmp_path / "sast" / f"{repo}.json").write_text(json.dumps({"results": [{"check_id": repo, "path": "f"}]}))
        (tmp_path / "conf" / repo).mkdir(parents=True)
        (tmp_path / "conf" / repo / "c.json").write_text(json.dumps({"authors": [{"email": f"{repo}@x", "name": "N", "short": ""}]}))
    assert sorted((r.repo_id, r.rule_id) for r in read_gitleaks_json(spark, str(tmp_path / "secrets")).collect()) == [
        ("one", "gitleaks:one"), ("two", "gitleaks:two")]
    assert sorted((r.repo_id, r.rule_id) for r in read_semgrep_json(spark, str(tmp_path / "sast")).collect()) == [
        ("one", "semgrep:one"), ("two", "semgrep:two")]
    assert sorted((r.repo_id, r.email, r.short) for r in read_roster(spark, str(tmp_path / "conf")).collect()) == [
        ("one", "one@x", "N"), ("two", "two@x", "N")]


def test_overlapping_exports_count_a_commit_once(spark, tmp_path):
    record = "\x1eabc\x1fA\x1fa@x\x1f2026-01-01T00:00:00Z\x1f2026-01-01T00:00:00Z\x1fs\n\n3\t1\tlib/m.py\n"
    for name in ("first.txt", "second.txt"):
        (tmp_path / name).write_text(record)
    rows = read_numstat(spark, f"{tmp_path}/*.txt", "r").collect()
    assert [(r.sha, r.path, r.added, r.deleted) for r in rows] == [("abc", "lib/m.py", 3, 1)]


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"period": {"start": "2026-01-01"}, "authors": [
        {"email": "b@x", "name": "Bo", "gitGrade": "B", "hideFromCards": True, "badge": {"kind": "up", "text": "t"}},
        {"email": "a@x", "name": "Ann", "short": "an"}]}))
    got = read_roster(spark, str(tmp_path / "c.json"), "r").orderBy("position").collect()
    assert [(r.email, r.short, r.git_grade, r.code_grade, r.hide_from_cards) for r in got] == [
        ("b@x", "Bo", "B", "", True), ("a@x", "an", "", "", False)]
    assert got[0].badge.kind == "up"
    (tmp_path / "ignore").write_text("# no\n legacy/** \n\n*.min.js\n")
    assert read_ignore_patterns(spark, str(tmp_path / "ignore")) == ["legacy/**", "*.min.js"]
    people = spark.createDataFrame([("r", "a@x", "Ann Lee", 3)], "repo_id STRING, email STRING, name STRING, commits LONG")
    write_roster(people, str(tmp_path / "roster"))
    assert spark.read.json(str(tmp_path / "roster")).first().short == "Ann"


def _rows(commits, n, start=0):
    return commits([(str(i), f"N{i % 3}", f"N{i % 3}@X", f"2026-0{1 + i % 4}-1{i % 9}", "feat: a" if i % 2 else "b #1") for i in range(start, n)])


def test_streamed_metrics_equal_the_batch(spark, commits, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first, second = _rows(commits, 40), _rows(commits, 70, 30)  # ten commits arrive twice
    first.repartition(3).write.parquet(source)
    run = lambda: stream_author_metrics(read_commit_stream(spark, source, files_per_batch=1), out, state).awaitTermination()
    run()
    second.write.mode("append").parquet(source)
    run()
    got = current_metrics(spark, out)
    want = author_metrics(_rows(commits, 70)).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_snapshots(spark, commits, tmp_path):
    source, totals, snaps, state = (str(tmp_path / n) for n in ("in", "totals", "snaps", "state"))
    run = lambda: stream_snapshots(read_commit_stream(spark, source), totals, snaps, state).awaitTermination()
    _rows(commits, 20).write.parquet(source)
    run()
    _rows(commits, 50, 20).write.mode("append").parquet(source)
    run()
    assert latest_snapshot(read_snapshots(spark, snaps)).agg(F.sum("commits")).first()[0] == 50


def test_bounded_deduplication_state(spark, commits, tmp_path):
    _rows(commits, 5).write.parquet(str(tmp_path / "in"))
    stream = monthly_metrics(distinct_commits(read_commit_stream(spark, str(tmp_path / "in")), within="10 days"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("bounded").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("bounded").agg(F.sum("commits")).first()[0] == 5


def test_commits_by_month(spark, commits, tmp_path):
    write_by_month(_rows(commits, 30), str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    recent = author_metrics(stored, "2026-03-05")
    assert sorted(map(tuple, recent.collect())) == sorted(map(tuple, author_metrics(_rows(commits, 30), "2026-03-05").collect()))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "commit_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert stored.count() == 30 and stored.select("commit_month").distinct().count() == 4


def test_a_long_stream_keeps_two_generations(spark, commits, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    sizes = []
    for k in range(10):
        _rows(commits, 40).coalesce(1).write.mode("append").parquet(source)  # the same commits again and again
        stream_author_metrics(
            read_commit_stream(spark, source, files_per_batch=1), out, state).awaitTermination()
        sizes.append(sum(f.stat().st_size for f in (tmp_path / "out").rglob("*.parquet")))
    assert max(sizes) <= 2.5 * sizes[0]
    got = current_metrics(spark, out)
    want = author_metrics(_rows(commits, 40)).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_files_that_are_no_text_leave_with_a_reason(spark, tmp_path):
    texts = {"one/a.py": "x é\n".encode(), "one/bad.py": b"caf\xe9", "two/lib/empty.py": b"\n", "two/big.py": b"y" * 50, "three/nul.py": b"a\x00b"}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = read_file_bytes(spark, str(tmp_path), most_bytes=40)
    assert sorted((r.repo_id, r.path, r.n_bytes, r.content, r.problem) for r in rows.collect() if r.problem is None) == [
        ("one", "a.py", 5, "x é\n", None), ("three", "nul.py", 3, "a\x00b", None), ("two", "lib/empty.py", 1, "\n", None)]
    assert sorted((r.repo_id, r.path, r.n_bytes, r.content, r.problem) for r in rows.collect() if r.problem) == [
        ("one", "bad.py", 4, None, "not UTF-8"), ("two", "big.py", 50, None, "too large")]
    assert readable(rows).columns == ["repo_id", "path", "content"] and readable(rows).count() == 3


def test_export_makes_folders_and_odd_files_once(spark, tmp_path, monkeypatch):
    made = []

    class Store(fs.LocalFileSystem):
        def create_dir(self, path, *, recursive=True):
            made.append(path)
            super().create_dir(path, recursive=recursive)

        def open_output_stream(self, path, *args, **kwargs):
            made.append(path)
            return super().open_output_stream(path, *args, **kwargs)

    class Task:
        """Runs the function of a task here."""

        select = agg = lambda self, *columns: self
        collect = lambda self: None

        def mapInArrow(self, write, schema):
            rows = [("r0", f"src/a/d{k}.py", f"é{k}") for k in range(5)] + [("r1", "top.py", "")]
            batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some)], ["repo_id", "path", "content"]) for some in (rows[:3], rows[3:])]
            assert [b.to_pylist() for b in write(iter(batches))] == [[{"n": 6}]]
            return self

    monkeypatch.setattr(staging.fs, "LocalFileSystem", Store)
    staging.export_files(Task(), str(tmp_path))
    assert len(made) == len(set(made)) == 6 + 2 + 4  # files, odd files, folders
    found = {(r.repo_id, r.path): r.content for r in read_file_bytes(spark, str(tmp_path)).collect()}
    assert found == {("r0", f"src/a/d{k}.py"): f"é{k}" for k in range(5)} | {(r, staging.NOT_A_TEXT): None for r in ("r0", "r1")}


def test_files_known_by_length_take_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"f{k}").write_text("x")
    rows = read_file_bytes(spark, str(tmp_path), "r")
    once = spark.read.format("binaryFile").load(str(tmp_path)).rdd.getNumPartitions()
    assert rows.rdd.getNumPartitions() <= once + spark.sparkContext.defaultParallelism < 2 * once
    assert rows.count() == 300
