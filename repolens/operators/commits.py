"""Per-author commit analytics.

Every result is a ``groupBy`` whose partial aggregate runs before the shuffle, so a
repository or an author with a large share of all commits adds no more shuffled rows
than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions.commits import (
    email_key,
    git_grade,
    has_ticket,
    is_conventional,
    latest_day,
    month_of,
    percentage,
)
from repolens.functions.paths import path_matches
from repolens.operators.settings import drop_excluded
from repolens.operators.skew import join_per_repo


def in_period(commits: DataFrame, since: date | str | None) -> DataFrame:
    """Commits on or after the first day of the period (by commit time)."""
    if since is None:
        return commits
    inside = F.col("commit_ts") >= F.lit(str(since)).cast("timestamp")
    if "commit_month" in commits.columns:  # stored by month: earlier ones are not read
        inside = inside & (F.col("commit_month") >= str(since)[:7])
    return commits.filter(inside)


def with_email(commits: DataFrame) -> DataFrame:
    return commits.withColumn("email", email_key(F.col("author_email")))


def churn_by_repo(commits: DataFrame, commit_files: DataFrame, settings: DataFrame) -> DataFrame:
    """:func:`line_churn` with each repository's own excluded paths; ``commits`` are those of its period."""
    return line_churn(commits, drop_excluded(commit_files, settings))


def discover_authors(commits: DataFrame) -> DataFrame:
    """Authors by e-mail, named by their most frequent spelling, with commit counts."""
    spelled = (
        commits.filter((F.trim("author_name") != "") & (F.trim("author_email") != ""))
        .groupBy("repo_id", "author_name", "author_email")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        spelled.groupBy("repo_id", email_key(F.col("author_email")).alias("email"))
        .agg(
            F.trim(F.min_by("author_name", F.struct(-F.col("n"), F.col("author_name"), F.col("author_email"))))
            .alias("name"),
            F.sum("n").alias("commits"),
        )
        .select("repo_id", "email", "name", "commits")
    )


def author_metrics(commits: DataFrame, since: date | str | None = None) -> DataFrame:
    """Commits, conventional and ticket shares and last active day per author."""
    counted = (
        with_email(in_period(commits, since))
        .groupBy("repo_id", "email")
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.count_if(is_conventional(F.col("subject"))).alias("conv"),
            F.count_if(has_ticket(F.col("subject"))).alias("tickets"),
            latest_day(F.col("commit_ts"), F.col("author_date")).alias("last_active"),
        )
    )
    commits_, conv, tickets = F.col("commits"), F.col("conv"), F.col("tickets")
    return counted.withColumns({
        "conv_pct": percentage(conv, commits_),
        "ticket_pct": percentage(tickets, commits_),
    })


def with_git_grade(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn(
        "derived_git_grade", git_grade(F.col("commits"), F.col("conv_pct"), F.col("ticket_pct")))


def line_churn(
    commits: DataFrame, commit_files: DataFrame, *, exclude: Sequence[str] = (), since: date | str | None = None,
) -> DataFrame:
    """Lines added and deleted per author, without excluded paths.

    The per-file rows are summed per commit first: that shuffles one row per commit
    and map task instead of one per file, and the join reuses the same partitioning.
    """
    per_commit = (
        commit_files.filter(~path_matches(F.col("path"), exclude))
        .groupBy("repo_id", "sha")
        .agg(F.sum(F.coalesce("added", F.lit(0)).cast("long")).alias("added"),
             F.sum(F.coalesce("deleted", F.lit(0)).cast("long")).alias("deleted"))
    )
    authors = with_email(in_period(commits, since)).select("repo_id", "sha", "email")
    return (
        authors.join(per_commit, ["repo_id", "sha"], "left")
        .groupBy("repo_id", "email")
        .agg(F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
             F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))
    )


def monthly_cadence(commits: DataFrame, since: date | str | None = None) -> DataFrame:
    """Commits per author and month (long form)."""
    return (
        with_email(in_period(commits, since))
        .groupBy("repo_id", "email", month_of(F.col("author_date")).alias("month"))
        .agg(F.count(F.lit(1)).alias("commits"))
    )


def months_map(cadence: DataFrame) -> DataFrame:
    """The long form as one ``month -> commits`` map per author (a row per calendar month at most)."""
    return cadence.groupBy("repo_id", "email").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", "commits")))).alias("months"))


def date_bounds(commits: DataFrame) -> DataFrame:
    """First author date and data-through date (author date of the latest commit)."""
    return commits.groupBy("repo_id").agg(
        F.min("author_date").alias("first_date"), latest_day(F.col("commit_ts"), F.col("author_date")).alias("through_date"))


def commits_since(commits: DataFrame, last_dates: DataFrame) -> DataFrame:
    """Commits per author on or after each repository's ``last_date`` (inclusive).

    Commits are counted per day first, so the date join sees one row per author and
    day at most.
    """
    daily = (
        with_email(commits)
        .groupBy("repo_id", "email", F.to_date("commit_ts").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        join_per_repo(daily, last_dates.select("repo_id", "last_date"), ["email"])
        .filter(F.col("day") >= F.col("last_date"))
        .groupBy("repo_id", "email")
        .agg(F.sum("n").alias("since"))
    )
