"""Each repository's own settings, applied to all repositories in one job.

Settings are a small table, a row for each repository; paths, commits and hits meet it by ``repo_id``, salted, so that
neither a large number of repositories nor one that holds most rows is a burden. File texts never do: all files are scanned by all
rules once, and the settings decide about the hits, which are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.paths import globs_column_to_regex, normalise_path
from repolens.operators.languages import present_packs
from repolens.operators.scan import FILE_ROW, file_packs
from repolens.operators.skew import join_per_repo
from repolens.rules import PACKS, Rule

#: The first month that commits of a repository without a start are looked for in.
FIRST_MONTH = "1970-01"


def _excluded() -> Column:
    return F.coalesce(F.regexp_like(normalise_path(F.col("path")), F.col("_exclude")), F.lit(False))


def drop_excluded(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Rows without those whose ``path`` their repository excludes; rows of repositories without settings stay."""
    own = settings.select("repo_id", globs_column_to_regex(F.col("exclude")).alias("_exclude")).filter("_exclude IS NOT NULL")
    return join_per_repo(rows, own, ["path"], "left").filter(~_excluded()).drop("_exclude")


def explicit_language(language: Column) -> Column:
    """The pack of a named language; null, meaning detection, for no or an unknown name."""
    return F.when(language.isin(list(PACKS)), language)


def granted_packs(files: DataFrame, settings: DataFrame) -> DataFrame:
    """The packs of each repository: the one its settings name, else its languages' and the generic one."""
    found = present_packs(files).join(settings.select("repo_id", explicit_language(F.col("language")).alias("named")), "repo_id", "left")
    return found.select("repo_id", F.when(F.col("named").isNotNull(), F.array("named")).otherwise(F.col("packs")).alias("packs"))


def _rule_packs(rules: Sequence[Rule]) -> Column:
    """The packs of the row's rule, from a literal map."""
    pairs = [x for r in rules for x in (F.lit(r.rule_id), F.array(*map(F.lit, r.packs)))]
    return F.element_at(F.create_map(*pairs), F.col("rule_id")) if pairs else F.lit(None).cast("array<string>")


def allowed_hits(rows: DataFrame, settings: DataFrame, rules: Sequence[Rule], family: str) -> DataFrame:
    """Hits, and file rows, of a scan that the settings of their repository allow.

    Excluded paths and disabled rules go. Where a language is named, its pack alone counts: files it takes in, by its own rules.
    """
    own = settings.select(
        "repo_id", globs_column_to_regex(F.col("exclude")).alias("_exclude"), F.col("disabled").alias("_disabled"),
        explicit_language(F.col("language")).alias("_named"))
    rule, named = F.col("rule_id"), F.col("_named")
    in_pack = F.array_contains(file_packs(F.col("path"), family), named) & (
        (rule == FILE_ROW) | F.coalesce(F.array_contains(_rule_packs(rules), named), F.lit(False)))
    allowed = (
        ~_excluded() & ~F.coalesce(F.array_contains("_disabled", rule), F.lit(False)) & (named.isNull() | F.coalesce(in_pack, F.lit(False))))
    return join_per_repo(rows, own, ["path", "line_no"], "left").filter(allowed).drop("_exclude", "_disabled", "_named")


def drop_disabled(rows: DataFrame, settings: DataFrame, rule_id: str) -> DataFrame:
    """Rows of repositories that don't disable this rule."""
    off = settings.filter(F.array_contains("disabled", rule_id)).select("repo_id", F.lit(True).alias("_off"))
    return join_per_repo(rows, off, ["path"], "left").filter("_off IS NULL").drop("_off")


def drop_exempt(findings: DataFrame, settings: DataFrame) -> DataFrame:
    """Findings of any source without those on paths or of rules that their repository leaves out."""
    own = settings.select("repo_id", globs_column_to_regex(F.col("exclude")).alias("_exclude"), F.col("disabled").alias("_disabled"))
    off = _excluded() | F.coalesce(F.array_contains("_disabled", F.col("rule_id")), F.lit(False))
    return join_per_repo(findings, own, ["path", "line_no"], "left").filter(~off).drop("_exclude", "_disabled")


def repo_months(settings: DataFrame, through: date | str) -> DataFrame:
    """``(repo_id, commit_month, since)``: the months from each repository's start to that of ``through``."""
    last = F.to_date(F.lit(str(through)[:7] + "-01"))
    first = F.coalesce(F.trunc("since", "month"), F.to_date(F.lit(FIRST_MONTH + "-01")))
    months = settings.filter(first <= last).select("repo_id", "since", F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("m"))
    # The bounds tell the optimizer that this side selects, so that it prunes months at run time.
    month = F.date_format("m", "yyyy-MM").alias("commit_month")
    return months.select("repo_id", month, "since").filter((F.col("commit_month") >= FIRST_MONTH) & (F.col("commit_month") <= str(through)[:7]))


def in_own_period(commits: DataFrame, settings: DataFrame) -> DataFrame:
    """Commits on or after their repository's start (by commit time); all of them where it has none.

    Commits stored by ``commit_month`` are joined by repository and month, up to the last month there is. Only months that some
    repository asks for are read then, and a repository's commits are dealt out by month; ``settings`` must have a row for each repository.
    """
    inside = F.col("_since").isNull() | (F.col("commit_ts") >= F.col("_since").cast("timestamp"))
    if "commit_month" in commits.columns:
        last = commits.agg(F.max("commit_month")).first()[0] or FIRST_MONTH  # the names of folders, no file's rows
        wanted = repo_months(settings, last + "-01").withColumnRenamed("since", "_since")
        joined = commits.join(wanted, ["repo_id", "commit_month"])
    else:
        starts = settings.filter("since IS NOT NULL").select("repo_id", F.col("since").alias("_since"))
        joined = join_per_repo(commits, starts, ["sha"], "left")
    return joined.filter(inside).select(*[F.col(c) for c in commits.columns])
