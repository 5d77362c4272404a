"""Change since the previous snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators.skew import join_per_repo

SNAPSHOT_VALUES = ("commits", "added", "deleted", "last_active")


def snapshot_rows(metrics: DataFrame, churn: DataFrame, bounds: DataFrame, last_dates: DataFrame) -> DataFrame:
    """Totals of active authors to keep for the next build."""
    dates = bounds.select("repo_id", F.col("through_date").alias("compiled_date")).join(
        last_dates.select("repo_id", F.col("last_date").alias("previous_compiled_date")), "repo_id", "left")
    active = metrics.filter(F.col("commits") > 0).join(churn, ["repo_id", "email"], "left")
    return (
        join_per_repo(active, dates, ["email"])
        .select("repo_id", "email", "commits", F.coalesce("added", F.lit(0)).alias("added"),
                F.coalesce("deleted", F.lit(0)).alias("deleted"), "last_active",
                "previous_compiled_date", "compiled_date")
    )


def last_dates(bounds: DataFrame, snapshot: DataFrame | None, period_start: str | None = None) -> DataFrame:
    """Start of the delta per repository: last snapshot, else period start, else first commit."""
    fallback = F.lit(period_start).cast("date") if period_start else F.col("first_date")
    if snapshot is None:
        return bounds.select("repo_id", F.coalesce(fallback, "first_date").alias("last_date"))
    compiled = snapshot.groupBy("repo_id").agg(F.max("compiled_date").alias("compiled_date"))
    return bounds.join(compiled, "repo_id", "left").select(
        "repo_id", F.coalesce("compiled_date", fallback).alias("last_date"))


def delta_vs_snapshot(metrics: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Commits now against the snapshot; null for authors the snapshot does not know."""
    before = snapshot.select("repo_id", "email", F.col("commits").alias("previous_commits"))
    return metrics.select("repo_id", "email", "commits").join(before, ["repo_id", "email"], "left").withColumn(
        "vs_snapshot", F.col("commits") - F.col("previous_commits"))


def delta_report(metrics: DataFrame, since: DataFrame, snapshot: DataFrame, grades: DataFrame | None = None) -> DataFrame:
    """Active authors by new commits, with the change since the last build."""
    report = (
        delta_vs_snapshot(metrics.filter(F.col("commits") > 0), snapshot)
        .join(since, ["repo_id", "email"], "left")
        .withColumn("since", F.coalesce("since", F.lit(0)))
    )
    if grades is not None:
        star = lambda grade, auto: F.concat(F.coalesce(grade, F.lit("—")), F.when(auto, F.lit("*")).otherwise(F.lit("")))
        marked = grades.select("repo_id", "email", F.concat_ws(
            "/", star("git_grade", F.col("auto_git")), star("code_grade", F.col("auto_code"))).alias("grades"))
        report = report.join(marked, ["repo_id", "email"], "left")
    return report.orderBy("repo_id", F.desc("since"), "email")
