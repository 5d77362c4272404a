"""Report configuration: roster and settings of each repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions.report import strip
from repolens.sources.git_export import report_repo

ROSTER_ENTRY = (
    "STRUCT<email: STRING, name: STRING, short: STRING, domain: STRING, gitGrade: STRING, codeGrade: STRING, "
    "highlight: BOOLEAN, hideFromCards: BOOLEAN, badge: STRUCT<kind: STRING, text: STRING>>"
)
CONFIG_SCHEMA = (
    f"period STRUCT<start: STRING>, excludePaths ARRAY<STRING>, disabledRules ARRAY<STRING>, language STRING, "
    f"authors ARRAY<{ROSTER_ENTRY}>"
)


def roster_rows(entries: DataFrame) -> DataFrame:
    """Roster table from ``repo_id, authors`` rows; ``position`` keeps the order of the list."""
    return entries.select("repo_id", F.posexplode("authors")).select(
        "repo_id", F.col("pos").alias("position"), "col.email", "col.name",
        F.coalesce(F.nullif("col.short", F.lit("")), "col.name").alias("short"), F.coalesce("col.domain", F.lit("")).alias("domain"),
        F.coalesce("col.gitGrade", F.lit("")).alias("git_grade"),
        F.coalesce("col.codeGrade", F.lit("")).alias("code_grade"), F.col("col.badge").alias("badge"),
        F.coalesce("col.highlight", F.lit(False)).alias("highlight"),
        F.coalesce("col.hideFromCards", F.lit(False)).alias("hide_from_cards"))


def read_roster(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """The roster of a configuration file, or without ``repo_id`` those of many repositories."""
    config = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True)
    return roster_rows(config.select(report_repo(spark, path, repo_id).alias("repo_id"), "authors"))


def roster_from_authors(authors: DataFrame) -> DataFrame:
    """Roster of a repository without configuration: everybody who committed."""
    # Order and short name are those of the discovered list; ties go by e-mail.
    return authors.select(
        "repo_id", (-F.col("commits")).alias("position"), "email", "name",
        F.element_at(F.split("name", " "), 1).alias("short"), F.lit("").alias("domain"),
        F.lit("").alias("git_grade"), F.lit("").alias("code_grade"),
        F.lit(None).cast("struct<kind:string,text:string>").alias("badge"),
        F.lit(False).alias("highlight"), F.lit(False).alias("hide_from_cards"))


def write_roster(authors: DataFrame, path: str) -> None:
    """The discovered authors as an editable roster, one JSON object per author."""
    roster_from_authors(authors).drop("position").write.mode("overwrite").partitionBy("repo_id").json(path)


def read_ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Globs of an ignore file: one per line, blanks and ``#`` comments dropped.

    A hand-written list that becomes part of a regex literal, so it is read here.
    """
    lines = spark.read.text(path).select(strip(F.col("value")).alias("glob"))
    return [r.glob for r in lines.filter((F.col("glob") != "") & ~F.col("glob").startswith("#")).collect()]


def settings_rows(config: DataFrame) -> DataFrame:
    """Settings from ``repo_id`` and configuration columns: ``since, exclude, disabled, language``.

    One row per repository. A start that is no day is none; lists are never null.
    """
    nothing = F.array().cast("array<string>")
    return config.select(
        "repo_id", F.to_date(F.try_to_timestamp(F.substring("period.start", 1, 10), F.lit("yyyy-MM-dd"))).alias("since"),
        F.coalesce("excludePaths", nothing).alias("exclude"), F.coalesce("disabledRules", nothing).alias("disabled"),
        F.nullif(strip(F.coalesce("language", F.lit(""))), F.lit("")).alias("language"))


def read_settings(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """The settings of a configuration file, or without ``repo_id`` those of many repositories."""
    config = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True, recursiveFileLookup=True)
    return settings_rows(config.withColumn("repo_id", report_repo(spark, path, repo_id)))


def ignore_rows(lines: DataFrame) -> DataFrame:
    """``(repo_id, globs)`` from ``(repo_id, value)`` lines of ignore files: trimmed, without blanks and ``#`` comments."""
    globs = lines.select("repo_id", strip(F.col("value")).alias("glob")).filter(
        (F.col("glob") != "") & ~F.col("glob").startswith("#"))
    return globs.groupBy("repo_id").agg(F.array_sort(F.collect_set("glob")).alias("globs"))


def read_ignore_files(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """The globs of an ignore file, or without ``repo_id`` of one for each of many repositories."""
    lines = spark.read.text(path, recursiveFileLookup=True)
    return ignore_rows(lines.withColumn("repo_id", report_repo(spark, path, repo_id)))


def merged_settings(
    repos: DataFrame, settings: DataFrame, ignored: DataFrame | None = None, *, exclude: Sequence[str] = (),
    disabled: Sequence[str] = (),
) -> DataFrame:
    """One row for each of ``repos``: its settings, its ignore file's globs and what the caller adds for all, without repeats.

    Repositories without a configuration have only what the caller adds.
    """
    def listed(values: Sequence[str]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    out = repos.select("repo_id").distinct().join(settings, "repo_id", "left")
    if ignored is not None:
        out = out.join(ignored, "repo_id", "left")
    parts = ["exclude", *["globs"] * (ignored is not None)]
    paths = F.concat(*[F.coalesce(c, listed(())) for c in parts], listed(exclude))
    return out.select(
        "repo_id", "since", F.array_distinct(F.array_compact(paths)).alias("exclude"),
        F.array_distinct(F.array_compact(F.concat(F.coalesce("disabled", listed(())), listed(disabled)))).alias("disabled"), "language")
