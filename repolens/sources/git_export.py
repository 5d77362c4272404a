"""Readers for text exports of a repository's history.

Exports to produce once per repository::

    git log --all --date=iso-strict --format='%x1e%H%x1f%an%x1f%ae%x1f%ad%x1f%cd%x1f%s' --numstat
    git blame --line-porcelain -w -- <file>          (one text file per source file)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD, FIELD = "\x1e", "\x1f"


def _log_records(text: DataFrame) -> DataFrame:
    """Header fields and numstat body of every record (``repo_id, value`` rows)."""
    header = F.split(F.substring_index("value", "\n", 1), FIELD, -1)
    return (
        text.filter(F.contains("value", F.lit(FIELD)))
        .select("repo_id", header.alias("h"),
                F.expr("substring(value, instr(value, '\\n') + 1)").alias("body"),
                F.contains("value", F.lit("\n")).alias("has_body"))
    )


def parse_commit_log(text: DataFrame) -> DataFrame:
    """Commits from log records.  A commit listed more than once in an export counts once."""
    h = F.col("h")
    return (
        _log_records(text)
        .select(
            "repo_id", h[0].alias("sha"), h[1].alias("author_name"), h[2].alias("author_email"),
            F.substring(h[3], 1, 10).try_cast("date").alias("author_date"),
            h[4].try_cast("timestamp").alias("commit_ts"), h[5].alias("subject"))
        .dropDuplicates(["repo_id", "sha"])
    )


def parse_numstat(text: DataFrame) -> DataFrame:
    """File changes from log records; counts of binary files are null, other rows are ignored.

    A commit that several exports list has its changes once: those of its longest record.
    """
    row = F.split(F.col("line"), "\t", -1)
    records = (
        _log_records(text).filter("has_body").groupBy("repo_id", F.col("h")[0].alias("sha"))
        .agg(F.max(F.struct(F.length("body"), "body"))["body"].alias("body"))
    )
    return (
        records.select("repo_id", "sha", F.explode(F.split("body", "\n", -1)).alias("line"))
        .select("repo_id", "sha", row.alias("f"))
        .filter(F.size("f") >= 3)
        .select("repo_id", "sha", F.col("f")[2].alias("path"),
                F.col("f")[0].try_cast("int").alias("added"), F.col("f")[1].try_cast("int").alias("deleted"))
    )


def read_log_text(spark: SparkSession, path: str, repo_id: Column | str) -> DataFrame:
    """Raw log records, one row each: the record mark is the line separator of the text source."""
    repo = F.lit(repo_id) if isinstance(repo_id, str) else repo_id
    return spark.read.option("lineSep", RECORD).text(path).select(repo.alias("repo_id"), "value")


def read_commit_log(spark: SparkSession, path: str, repo_id: Column | str) -> DataFrame:
    return parse_commit_log(read_log_text(spark, path, repo_id))


def read_numstat(spark: SparkSession, path: str, repo_id: Column | str) -> DataFrame:
    return parse_numstat(read_log_text(spark, path, repo_id))


def parse_blame(porcelain: DataFrame) -> DataFrame:
    """Blame lines from porcelain texts (``repo_id, path, value``), one text per file.

    Source lines start with a tab, so header words at the start of a line are headers.
    """
    names = F.regexp_extract_all(F.col("value"), F.lit(r"(?md)^author ([^\n]*)"), F.lit(1))
    emails = F.regexp_extract_all(F.col("value"), F.lit(r"(?md)^author-mail ([^\n]*)"), F.lit(1))
    return (
        porcelain.select("repo_id", "path", F.posexplode(F.arrays_zip(names.alias("name"), emails.alias("email"))))
        .select("repo_id", "path", (F.col("pos") + 1).alias("line_no"),
                F.trim(F.col("col.name")).alias("author_name"),
                F.trim(F.regexp_replace("col.email", "[<>]", "")).alias("author_email"))
    )


def relative_path(spark: SparkSession, root: str) -> Column:
    """Path of a row's file below the root folder, decoded."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    skipped = len(re.sub(r"^([a-z0-9]+):/+", r"\1:/", whole)) + 1
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    decoded = F.regexp_replace(F.url_decode(encoded), r"^([a-z0-9]+):/+", "$1:/")
    return F.substr(decoded, F.lit(skipped + 1))


def repo_and_path(spark: SparkSession, root: str, repo_id: str | None) -> tuple[Column, Column]:
    """Repository and path of a row's file.

    With no ``repo_id`` the folders right below the root are repositories, named like them, so one
    read takes in any number of them.
    """
    path = relative_path(spark, root)
    if repo_id is not None:
        return F.lit(repo_id), path
    repo = F.substring_index(path, "/", 1)
    return repo, F.substr(path, F.length(repo) + 2)


def report_repo(spark: SparkSession, root: str, repo_id: str | None) -> Column:
    """Repository of a row's report: given, or named by the folder or the JSON file below the root."""
    if repo_id is not None:
        return F.lit(repo_id)
    return F.regexp_replace(F.substring_index(relative_path(spark, root), "/", 1), r"\.json$", "")


def _texts_below(spark: SparkSession, root: str, repo_id: str | None) -> DataFrame:
    repo, path = repo_and_path(spark, root, repo_id)
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return texts.select(repo.alias("repo_id"), path.alias("path"), "value")


def read_blame(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """Blame of every text below ``root``; its relative path is the source file's path."""
    return parse_blame(_texts_below(spark, root, repo_id))


def read_files(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """Whole texts of the files below ``root``; the scan's globs and filters apply to ``path``."""
    return _texts_below(spark, root, repo_id).withColumnRenamed("value", "content")
