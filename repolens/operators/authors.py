"""Roster clean-up and loose matching between roster keys and commit authors.

A roster key may be only a part of an address.  Instead of comparing every author
with every key, the authors' (or keys') substrings of the lengths that occur on the
other side are joined by equality, which partitions by hash like any other join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.commits import email_key
from repolens.operators.skew import join_per_repo


def dedupe_roster(roster: DataFrame) -> DataFrame:
    """First entry per normalised e-mail in roster order; blank addresses go."""
    fields = [c for c in roster.columns if c not in ("repo_id",)]
    key = email_key(F.coalesce("email", F.lit("")))
    return (
        roster.withColumn("email_key", key)
        .filter(F.col("email_key") != "")
        .groupBy("repo_id", "email_key")
        .agg(F.min_by(F.struct(*fields), F.col("position")).alias("entry"))
        .select("repo_id", "entry.*", "email_key")
        .withColumn("email", F.col("email_key"))
        .drop("email_key")
    )


def visible_authors(roster: DataFrame) -> DataFrame:
    return roster.filter(~F.coalesce("hide_from_cards", F.lit(False)))


def reported(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """Rows by author of the people a report shows: those of the roster (its e-mails are keys)."""
    return rows.join(roster.select("repo_id", "email"), ["repo_id", "email"], "left_semi")


def active_authors(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("commits") > 0)


def _lengths(keys: DataFrame) -> DataFrame:
    """The distinct key lengths of each repository: a handful of small numbers."""
    return keys.groupBy("repo_id").agg(F.collect_set(F.length("key")).alias("lengths"))


def _substrings(text: Column, lengths: Column) -> Column:
    """Distinct substrings of the given lengths."""
    starts = F.transform(
        F.filter(lengths, lambda n: (n > 0) & (n <= F.length(text))),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))
    return F.array_distinct(F.flatten(starts))


def contained_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """All ``(repo_id, text, key)`` where the key is a substring of the text.

    ``texts`` and ``keys`` hold distinct ``repo_id, text`` and ``repo_id, key`` rows.
    """
    pieces = (
        join_per_repo(texts, _lengths(keys), ["text"])
        .select("repo_id", "text", F.explode(_substrings(F.col("text"), F.col("lengths"))).alias("key"))
    )
    return pieces.join(keys, ["repo_id", "key"]).select("repo_id", "text", "key")


def match_author_contains(commits: DataFrame, roster: DataFrame) -> DataFrame:
    """Commits per roster key that occurs in ``Name <email>`` (opt-in loose matching)."""
    signatures = (
        commits.groupBy("repo_id", F.concat(
            F.col("author_name"), F.lit(" <"), F.col("author_email"), F.lit(">")).alias("text"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = roster.select("repo_id", F.col("email").alias("key")).filter(F.col("key") != "").distinct()
    matched = contained_keys(signatures.select("repo_id", "text"), keys)
    return (
        matched.join(signatures, ["repo_id", "text"])
        .groupBy("repo_id", F.col("key").alias("email"))
        .agg(F.sum("n").alias("commits"))
    )


def missing_authors(authors: DataFrame, roster: DataFrame) -> DataFrame:
    """Commit authors with no roster key that contains, or is contained in, their e-mail.

    Exact matches, nearly all of them, leave in a first equality join; only the rest
    is cut into substrings.
    """
    keys = roster.select("repo_id", email_key(F.col("email")).alias("key")).filter(F.col("key") != "").distinct()
    unmatched = authors.join(keys.withColumnRenamed("key", "email"), ["repo_id", "email"], "left_anti")
    emails = unmatched.select("repo_id", F.col("email").alias("text"))
    holds_key = contained_keys(emails, keys).select("repo_id", F.col("text").alias("email"))
    inside_key = contained_keys(
        keys.select("repo_id", F.col("key").alias("text")), emails.select("repo_id", F.col("text").alias("key"))
    ).select("repo_id", F.col("key").alias("email"))
    known = holds_key.union(inside_key)
    return unmatched.join(known, ["repo_id", "email"], "left_anti")


def missing_summary(missing: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` missing authors of each repository by commits, with the count of the rest."""
    order = Window.partitionBy("repo_id").orderBy(F.col("commits").desc(), F.col("email"))
    first = missing.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    totals = missing.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_missing"))
    return first.join(totals, "repo_id").withColumn(
        "n_more", F.greatest(F.col("n_missing") - top, F.lit(0)))
