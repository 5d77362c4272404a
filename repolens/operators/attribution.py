"""Who owns which line: joins of hits with blame and per-author tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions.commits import email_key
from repolens.rules import LARGE_RULE_ID

UNKNOWN = "unknown"


def attribute_hits(hits: DataFrame, blame_lines: DataFrame, *, stored: bool = False) -> DataFrame:
    """Left join of hits with the blame author of their line.

    The key is one line of one file, so no key is hot.  Adds ``author_name``
    (``unknown`` without blame) and ``author_email`` (null without blame).

    Blame has a row per line, hits are few.  A left join cannot broadcast its left
    side, so for ``stored`` hits, which are cheap to read twice, blame is first cut
    down to the hit lines by a semi join: Spark broadcasts the keys when they turn out
    small and shuffles both sides when they do not.
    """
    key = ["repo_id", "path", "line_no"]
    owners = blame_lines.select(*key, "author_name", "author_email")
    if stored:
        owners = owners.join(hits.select(*key), key, "left_semi")
    return hits.join(owners, key, "left").withColumn("author_name", F.coalesce("author_name", F.lit(UNKNOWN)))


def blame_by_file(blame_lines: DataFrame) -> DataFrame:
    """Lines per file and author with the first of them: blame, reduced before it is joined."""
    return blame_lines.groupBy("repo_id", "path", email_key(F.col("author_email")).alias("email")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


def lines_owned(blame_files: DataFrame, readable: DataFrame) -> DataFrame:
    """Blamed lines per author in the scanned files."""
    scanned = readable.select("repo_id", "path")
    return (
        blame_files.join(scanned, ["repo_id", "path"], "left_semi")
        .groupBy("repo_id", "email")
        .agg(F.sum("n").alias("lines_owned"))
    )


def majority_owner(blame_files: DataFrame) -> DataFrame:
    """Author of most lines of each file; a tie goes to the earliest line."""
    return blame_files.groupBy("repo_id", "path").agg(
        F.max_by("email", F.struct(F.col("n"), -F.col("first_line"))).alias("email"))


def smell_counts(
    hits: DataFrame, blame_lines: DataFrame, large: DataFrame | None = None,
    blame_files: DataFrame | None = None, *, stored: bool = False,
) -> DataFrame:
    """Hits per author and rule; large files count for their majority owner."""
    counts = (
        attribute_hits(hits.select("repo_id", "path", "line_no", "rule_id", "n"), blame_lines, stored=stored)
        .select("repo_id", F.coalesce(email_key(F.col("author_email")), F.lit(UNKNOWN)).alias("email"),
                "rule_id", "n")
    )
    if large is not None:
        files = blame_files if blame_files is not None else blame_by_file(blame_lines)
        in_large = files.join(large.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
        counts = counts.union(majority_owner(in_large).select(
            "repo_id", "email", F.lit(LARGE_RULE_ID).alias("rule_id"), F.lit(1).alias("n")))
    return counts.groupBy("repo_id", "email", "rule_id").agg(F.sum("n").alias("n"))
