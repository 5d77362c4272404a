"""Blame as runs of lines: one row for each stretch of a file that one author owns.

A run is ``repo_id, path, first_line, last_line, author_name, author_email``. Files are mostly written in stretches, so runs are many
times fewer than lines; ownership is a sum of lengths, and a hit finds its run by an as-of search within its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.commits import email_key
from repolens.operators.attribution import UNKNOWN

RUN_COLUMNS = ("repo_id", "path", "first_line", "last_line", "author_name", "author_email")


def runs_of_lines(blame_lines: DataFrame) -> DataFrame:
    """Runs of line-by-line blame: neighbouring lines of one author. Lines without blame end a run.

    The number of a line less its place among the author's lines is the same for all lines of a run.
    """
    order = Window.partitionBy("repo_id", "path").orderBy("line_no")
    before = F.lag(F.struct("line_no", "author_name", "author_email")).over(order)
    begins = F.coalesce(
        (before["line_no"] != F.col("line_no") - 1) | ~before["author_name"].eqNullSafe(F.col("author_name"))
        | ~before["author_email"].eqNullSafe(F.col("author_email")), F.lit(True))
    numbered = blame_lines.withColumn("_begins", begins).withColumn("_run", F.sum(F.col("_begins").cast("int")).over(order))
    return numbered.groupBy("repo_id", "path", "_run").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.first("author_name").alias("author_name"),
        F.first("author_email").alias("author_email")).select(*RUN_COLUMNS)


def blame_by_file(runs: DataFrame) -> DataFrame:
    """Lines per file and author with the first of them, as :func:`.attribution.blame_by_file` counts them; no line is made."""
    return runs.groupBy("repo_id", "path", email_key(F.col("author_email")).alias("email")).agg(
        F.sum((F.col("last_line") - F.col("first_line") + 1).cast("long")).alias("n"), F.min("first_line").alias("first_line"))


def attribute_hits(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """Hits with the author of the run their line is in: ``unknown`` and a null address outside all runs.

    Runs are first cut down to the files that have hits. Then runs and hits of a file stand in one order by line, and each hit looks
    back to the last run that began: as many rows as there are runs and hits, however long a file or a run is.
    """
    key = ["repo_id", "path"]
    columns = [c for c in hits.columns if c not in ("author_name", "author_email")]
    asked = runs.join(hits.select(*key).distinct(), key, "left_semi")
    run = F.struct("last_line", "author_name", "author_email")
    # A run stands before the hits of its first line.
    both = asked.select(*key, F.col("first_line").alias("_line"), F.lit(0).alias("_kind"), run.alias("_run"), F.lit(None).cast(
        hits.select(F.struct(*columns).alias("h")).schema["h"].dataType).alias("_hit")).unionByName(
        hits.select(*key, F.col("line_no").alias("_line"), F.lit(1).alias("_kind"), F.struct(*columns).alias("_hit")), allowMissingColumns=True)
    back = Window.partitionBy(*key).orderBy("_line", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_owner", F.last("_run", ignorenulls=True).over(back)).filter("_kind = 1")
    inside = F.col("_owner.last_line") >= F.col("_hit.line_no")
    return found.select(
        *[F.col(f"_hit.{c}").alias(c) for c in columns],
        F.coalesce(F.when(inside, F.col("_owner.author_name")), F.lit(UNKNOWN)).alias("author_name"),
        F.when(inside, F.col("_owner.author_email")).alias("author_email"))
