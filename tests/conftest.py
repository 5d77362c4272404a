import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from repolens.session import session  # noqa: E402

ME = ("Alice", "alice@ex.com")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tree(spark):
    """Files and blame (every line by one author) of one small repository."""

    def build(files, author=ME, repo="r"):
        rows = [(repo, path, text) for path, text in files.items()]
        blame = [
            (repo, path, i + 1, *author)
            for path, text in files.items()
            for i in range(len(text.split("\n")) - (1 if text.endswith("\n") else 0))
        ]
        return (
            spark.createDataFrame(rows, "repo_id STRING, path STRING, content STRING"),
            spark.createDataFrame(
                blame, "repo_id STRING, path STRING, line_no INT, author_name STRING, author_email STRING"),
        )

    return build


@pytest.fixture
def commits(spark):
    """Commits from ``(sha, name, email, day, subject)`` rows."""

    def build(rows, repo="r"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(
            [(repo, *r) for r in rows],
            "repo_id STRING, sha STRING, author_name STRING, author_email STRING, day STRING, subject STRING")
        return df.select(
            "repo_id", "sha", "author_name", "author_email", F.to_date("day").alias("author_date"),
            F.to_timestamp("day").alias("commit_ts"), "subject")

    return build
