"""What changed since the last build, and the snapshot for the next one."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.operators import delta
from repolens.operators.authors import dedupe_roster, reported
from repolens.operators.commits import author_metrics, commits_since, date_bounds, line_churn
from repolens.operators.scoring import final_grades
from repolens.sources.snapshots import latest_snapshot


def delta_report(
    commits: DataFrame, roster: DataFrame, snapshots: DataFrame | None, *, grades: DataFrame | None = None,
    since: date | str | None = None, metrics: DataFrame | None = None, bounds: DataFrame | None = None,
) -> DataFrame:
    """Roster authors with commits, by new commits since the last build of their repository.

    ``metrics`` and ``bounds`` are used where they are at hand.
    """
    people = dedupe_roster(roster)
    bounds = date_bounds(commits) if bounds is None else bounds
    metrics = (author_metrics(commits, since) if metrics is None else metrics).join(people.select("repo_id", "email"), ["repo_id", "email"], "left_semi")
    previous = latest_snapshot(snapshots) if snapshots is not None else None
    start = delta.last_dates(bounds, previous, str(since) if since else None)
    if previous is None:
        previous = metrics.select("repo_id", "email", F.lit(None).cast("long").alias("commits")).limit(0)
    return delta.delta_report(
        metrics, commits_since(commits, start), previous, final_grades(people, metrics, grades))


def build_snapshot(
    commits: DataFrame, commit_files: DataFrame, snapshots: DataFrame | None = None, *,
    exclude: Sequence[str] = (), since: date | str | None = None, roster: DataFrame | None = None,
) -> DataFrame:
    """Rows to store after a build: those of the roster's authors, or of everybody who committed."""
    return snapshot_of(
        author_metrics(commits, since), line_churn(commits, commit_files, exclude=exclude, since=since), date_bounds(commits),
        snapshots, since=since, roster=roster)


def snapshot_of(
    metrics: DataFrame, churn: DataFrame, bounds: DataFrame, snapshots: DataFrame | None = None, *,
    since: date | str | None = None, roster: DataFrame | None = None,
) -> DataFrame:
    """The same from metrics, churn and bounds that are at hand."""
    previous = latest_snapshot(snapshots) if snapshots is not None else None
    if roster is not None:
        metrics = reported(metrics, dedupe_roster(roster))
    return delta.snapshot_rows(metrics, churn, bounds, delta.last_dates(bounds, previous, str(since) if since else None))
