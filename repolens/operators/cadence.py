"""Month heat map, cadence text, commit bars and staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.report import heat_intensity, is_stale, month_label, to_fixed
from repolens.operators.skew import join_per_repo

MONTHS_SHOWN = 6


def last_months(cadence: DataFrame, shown: int = MONTHS_SHOWN) -> DataFrame:
    """The last months with commits in each repository, numbered from the oldest."""
    months = cadence.select("repo_id", "month").distinct()
    newest = Window.partitionBy("repo_id").orderBy(F.col("month").desc())
    oldest = Window.partitionBy("repo_id").orderBy("month")
    return (
        months.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= shown)
        .withColumn("slot", F.row_number().over(oldest)).drop("age")
    )


def month_heatmap(cadence: DataFrame, bounds: DataFrame, shown: int = MONTHS_SHOWN) -> DataFrame:
    """Commits per author and shown month (long form) with label and shade."""
    months = last_months(cadence, shown)
    slots = months.groupBy("repo_id").agg(F.map_from_entries(F.collect_list(F.struct("month", "slot"))).alias("slots"))
    cells = join_per_repo(cadence, slots, ["email"]).withColumn("slot", F.col("slots")[F.col("month")]).filter(
        F.col("slot").isNotNull()).drop("slots")
    busiest = cells.groupBy("repo_id").agg(F.greatest(F.max("commits"), F.lit(1)).alias("busiest"))
    facts = busiest.join(bounds.select("repo_id", "through_date"), "repo_id")
    return join_per_repo(cells, facts, ["email"]).select(
        "repo_id", "email", "slot", "month", "commits",
        month_label(F.col("month"), F.col("through_date")).alias("label"),
        heat_intensity(F.col("commits"), F.col("busiest")).alias("intensity"))


def heatmap_wide(heatmap: DataFrame, shown: int = MONTHS_SHOWN) -> DataFrame:
    """One row per author, one column per shown month slot."""
    slots = list(range(1, shown + 1))
    wide = heatmap.groupBy("repo_id", "email").pivot("slot", slots).agg(F.sum("commits"))
    return wide.select("repo_id", "email", *(
        F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"month_{i}") for i in slots))


def cadence_text(heatmap: DataFrame) -> DataFrame:
    """``Jul 16 / Sep 9`` per author: at most one entry per shown month."""
    entry = F.struct("slot", F.concat("label", F.lit(" "), F.col("commits").cast("string")).alias("text"))
    return heatmap.groupBy("repo_id", "email").agg(
        F.array_join(F.sort_array(F.collect_list(entry))["text"], " / ").alias("cadence"))


def commit_bars(metrics: DataFrame) -> DataFrame:
    """Bar width of every author as a share of the busiest one, in percent."""
    top = metrics.groupBy("repo_id").agg(F.greatest(F.max("commits"), F.lit(1)).alias("max_commits"))
    return join_per_repo(metrics.select("repo_id", "email", "commits"), top, ["email"]).withColumn(
        "share", to_fixed(F.col("commits") / F.col("max_commits") * 100, 1).cast("double"))


def team_totals(metrics: DataFrame, heatmap: DataFrame) -> DataFrame:
    """Commits of the team, of its busiest author and of its busiest shown month cell."""
    commits = metrics.groupBy("repo_id").agg(
        F.sum("commits").alias("team_commits"), F.greatest(F.max("commits"), F.lit(1)).alias("max_commits"))
    cells = heatmap.groupBy("repo_id").agg(F.max("commits").alias("busiest"))
    return commits.join(cells, "repo_id", "left").withColumn(
        "max_month", F.greatest(F.coalesce("busiest", F.lit(1)), F.lit(1))).drop("busiest")


def staleness(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """Whether an author has been quiet for three weeks before the data-through date."""
    return join_per_repo(
        metrics.select("repo_id", "email", "last_active"), bounds.select("repo_id", "through_date"), ["email"]
    ).withColumn("stale", is_stale(F.col("last_active"), F.col("through_date")))
