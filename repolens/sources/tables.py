"""The canonical tables and how they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COMMITS = (
    "repo_id STRING, sha STRING, author_name STRING, author_email STRING, author_date DATE, "
    "commit_ts TIMESTAMP, subject STRING"
)
COMMIT_FILES = "repo_id STRING, sha STRING, path STRING, added INT, deleted INT"
FILES = "repo_id STRING, path STRING, content STRING"
BLAME_LINES = "repo_id STRING, path STRING, line_no INT, author_name STRING, author_email STRING"
FINDINGS = (
    "repo_id STRING, vector STRING, rule_id STRING, path STRING, line_no INT, severity STRING, snippet STRING, "
    "fix STRING, review BOOLEAN, author_name STRING, author_email STRING, source STRING, rule_position INT"
)
SNAPSHOTS = (
    "repo_id STRING, email STRING, commits BIGINT, added BIGINT, deleted BIGINT, last_active DATE, "
    "previous_compiled_date DATE, compiled_date DATE"
)
FILE_KEY = ("repo_id", "path")


def write_by_month(commits: DataFrame, path: str) -> None:
    """Commits partitioned by commit month, so that a period reads only its months."""
    from pyspark.sql import functions as F

    commits.withColumn("commit_month", F.date_format("commit_ts", "yyyy-MM")).write.mode("overwrite").partitionBy(
        "commit_month").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """A table bucketed by file: files and blame so stored join without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *FILE_KEY).sortBy(*FILE_KEY).saveAsTable(table)


def write_report_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings partitioned by vector; the repository stays a column, as there may be very many."""
    findings.write.mode("overwrite").partitionBy("vector").parquet(path)

