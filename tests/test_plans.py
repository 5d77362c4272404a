"""What the physical plans must and must not contain."""

import re

import pytest

from repolens.operators.attribution import attribute_hits
from repolens.operators.commits import author_metrics, line_churn
from repolens.operators.findings import security_findings
from repolens.operators.ranking import top_findings
from repolens.operators.scan import listed_files, readable_files, scan_rules
from repolens.plans.author_report import author_report, smell_scan
from repolens.rules import SMELL, SMELL_RULES
from repolens.sources.tables import BLAME_LINES, COMMIT_FILES, COMMITS, FILES, write_bucketed


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    out = {}
    for name, ddl in (("commits", COMMITS), ("commit_files", COMMIT_FILES), ("files", FILES), ("blame", BLAME_LINES)):
        path = str(root / name)
        spark.createDataFrame([], ddl).write.parquet(path)
        out[name] = spark.read.schema(ddl).parquet(path)
    roster = "repo_id STRING, position INT, email STRING, name STRING, short STRING, git_grade STRING, code_grade STRING, hide_from_cards BOOLEAN"
    out["roster"] = spark.createDataFrame([], roster)
    return out


def exchanged_columns(text):
    """Input columns of every shuffle in a formatted plan."""
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", text)


def test_texts_are_never_shuffled(stored):
    for df in (
        author_report(stored["commits"], stored["commit_files"], stored["roster"], stored["files"], stored["blame"]),
        top_findings(security_findings(stored["files"], stored["blame"])),
    ):
        text = plan(df)
        moved = exchanged_columns(text)
        assert moved and not any(re.search(r"\b(content|lines|numbered|lowered)#", cols) for cols in moved)
        for node in ("EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in text


def test_scan_has_no_shuffle_and_one_pass(stored):
    text = plan(scan_rules(readable_files(listed_files(stored["files"], SMELL)), SMELL_RULES))
    assert "Exchange" not in text and text.count(") Scan parquet") == 1


def test_columns_and_filters_reach_the_scan(stored):
    text = plan(author_metrics(stored["commits"], "2026-01-01"))
    assert "PushedFilters: [IsNotNull(commit_ts), GreaterThanOrEqual(commit_ts" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "author_name" not in schema and "sha" not in schema
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_churn_reuses_the_commit_partitioning(spark, stored):
    """Sums per commit and the join with commits share one partitioning by commit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(line_churn(stored["commits"], stored["commit_files"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and text.count(") Exchange\n") == 3


def test_top_findings_limits_before_the_shuffle(stored):
    assert "WindowGroupLimit" in plan(top_findings(security_findings(stored["files"], stored["blame"])))


def test_bucketed_tables_attribute_without_a_shuffle(spark, stored):
    write_bucketed(stored["files"], "files_b", 4)
    write_bucketed(stored["blame"], "blame_b", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = scan_rules(readable_files(listed_files(spark.table("files_b"), SMELL)), SMELL_RULES).drop("line", "previous")
        text = plan(attribute_hits(hits, spark.table("blame_b")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and ") Exchange" not in text


def test_smell_counts_combine_before_the_shuffle(stored):
    text = plan(smell_scan(stored["files"], stored["blame"]).counts)
    assert "partial_sum" in text


def test_stored_hits_cut_blame_down_first(spark, stored, tmp_path):
    found = security_findings(stored["files"], stored["blame"], store=str(tmp_path / "hits"))
    text = plan(found)
    assert "LeftSemi" in text and "content" not in text
