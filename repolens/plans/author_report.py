"""Author report: activity, churn, smells, ownership and grades per roster entry."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions.grades import chosen_grade, is_derived
from repolens.functions.report import format_k, grade_class, short_name, slug
from repolens.functions.suppression import DEFAULT_MARKERS, Markers
from repolens.operators.attribution import blame_by_file, lines_owned, smell_counts
from repolens.operators.authors import active_authors, dedupe_roster, visible_authors
from repolens.operators.commits import author_metrics, line_churn, with_git_grade
from repolens.operators.numbering import numbered
from repolens.operators.scan import (
    FILE_ROW,
    facts_from_rows,
    file_facts,
    large_files,
    listed_files,
    readable_files,
    scan_rules,
)
from repolens.operators.scoring import code_grades, issue_matrix, matrix_by_author
from repolens.operators.settings import allowed_hits, drop_disabled
from repolens.rules import LARGE_RULE_ID, SMELL, SMELL_RULES, Rule, select_rules


@dataclass(frozen=True)
class SmellScan:
    """Lazy results of one code scan."""

    hits: DataFrame
    counts: DataFrame
    owned: DataFrame
    grades: DataFrame


def smell_scan(
    files: DataFrame, blame_lines: DataFrame, *, rules: Sequence[Rule] = SMELL_RULES,
    packs: Sequence[str] | None = None, globs: Sequence[str] | None = None, exclude: Sequence[str] = (),
    disabled: Sequence[str] = (), markers: Markers = DEFAULT_MARKERS, store: str | None = None,
    settings: DataFrame | None = None,
) -> SmellScan:
    """Scan, attribute and score.  With ``globs`` every rule runs on exactly the files these name.

    A file that a smell rule can reach makes its own language present, so the packs of
    a repository need not be looked up here.

    With ``store``, a folder every executor sees, texts are read exactly once: hits and
    line counts are written there and everything else starts from them.  Without it each
    result reads the texts it needs when it runs.  ``settings`` of each repository decide about the stored hits, so they need a store.
    """
    if settings is not None and store is None:
        raise ValueError("settings of each repository need a store")
    active = select_rules(rules, disabled=disabled, packs=packs)
    readable = readable_files(listed_files(files, SMELL, packs=packs, globs=globs, exclude=exclude))
    rows = scan_rules(
        readable, active, markers=markers, scoped=globs is None and (packs is None or len(packs) > 1),
        file_rows=store is not None,
    ).drop("line", "previous")
    if store is None:
        hits, facts = rows, file_facts(readable)
    else:
        rows.write.mode("overwrite").parquet(store)
        rows = files.sparkSession.read.schema(rows.schema).parquet(store)
        if settings is not None:
            rows = allowed_hits(rows, settings, active, SMELL)
        hits, facts = rows.filter(F.col("rule_id") != FILE_ROW), facts_from_rows(rows)
    large = None if LARGE_RULE_ID in disabled else large_files(facts)
    if settings is not None and large is not None:
        large = drop_disabled(large, settings, LARGE_RULE_ID)
    by_file = blame_by_file(blame_lines)
    counts = smell_counts(hits, blame_lines, large, by_file, stored=store is not None)
    owned = lines_owned(by_file, facts)
    return SmellScan(hits, counts, owned, code_grades(counts, owned, rules))


def author_report(
    commits: DataFrame, commit_files: DataFrame, roster: DataFrame, files: DataFrame | None = None,
    blame_lines: DataFrame | None = None, *, since: date | str | None = None, exclude: Sequence[str] = (),
    disabled: Sequence[str] = (), rules: Sequence[Rule] = SMELL_RULES, packs: Sequence[str] | None = None,
    markers: Markers = DEFAULT_MARKERS, store: str | None = None,
) -> DataFrame:
    """One row per roster entry.  Without ``files`` there is no code scan and no derived code grade."""
    scan = None
    if files is not None and blame_lines is not None:
        scan = smell_scan(files, blame_lines, rules=rules, packs=packs, exclude=exclude, disabled=disabled,
                          markers=markers, store=store)
    return author_cards(
        dedupe_roster(roster), author_metrics(commits, since),
        line_churn(commits, commit_files, exclude=exclude, since=since), scan.grades if scan else None)


def author_cards(roster: DataFrame, metrics: DataFrame, churn: DataFrame, grades: DataFrame | None) -> DataFrame:
    """Roster with metrics, churn and grades; people without commits get zeros.

    All sides are aggregates by author, so every join is on the same key.
    """
    key = ["repo_id", "email"]
    out = roster.join(with_git_grade(metrics), key, "left").join(churn, key, "left")
    if grades is not None:
        out = out.join(grades, key, "left")
        score, owned = F.coalesce("score", F.lit(0)), F.coalesce("lines_owned", F.lit(0))
        code, scanned = F.coalesce("derived_code_grade", F.lit("A")), F.lit(True)
    else:
        score = owned = F.lit(None).cast("long")
        code, scanned = F.lit(None).cast("string"), F.lit(False)
    zero = F.lit(0)
    git_grade = chosen_grade(F.col("git_grade"), F.coalesce("derived_git_grade", F.lit("D")))
    code_grade = chosen_grade(F.col("code_grade"), code)
    added, deleted = F.coalesce("added", zero), F.coalesce("deleted", zero)
    return out.select(
        "repo_id", "email", "name", short_name(F.col("name")).alias("short_name"), slug(F.col("name")).alias("slug"),
        F.coalesce("commits", zero).alias("commits"), F.coalesce("conv", zero).alias("conv"),
        F.coalesce("tickets", zero).alias("tickets"), F.coalesce("conv_pct", zero).alias("conv_pct"),
        F.coalesce("ticket_pct", zero).alias("ticket_pct"), "last_active",
        added.alias("added"), deleted.alias("deleted"), format_k(added).alias("added_text"),
        format_k(deleted).alias("deleted_text"), score.alias("score"), owned.alias("lines_owned"),
        git_grade.alias("git_grade"), code_grade.alias("code_grade"),
        grade_class(git_grade).alias("git_class"), grade_class(code_grade).alias("code_class"),
        is_derived(F.col("git_grade")).alias("auto_git"),
        (is_derived(F.col("code_grade")) & scanned).alias("auto_code"),
        F.coalesce("hide_from_cards", F.lit(False)).alias("hide_from_cards"))


def matrix_people(commits: DataFrame, roster: DataFrame, *, since: date | str | None = None) -> DataFrame:
    """The visible authors with commits, one row each."""
    return people_of_matrix(author_metrics(commits, since), roster)


def people_of_matrix(metrics: DataFrame, roster: DataFrame) -> DataFrame:
    active = active_authors(metrics).select("repo_id", "email")
    cards = visible_authors(dedupe_roster(roster)).join(active, ["repo_id", "email"], "left_semi")
    return cards.withColumn("short", F.coalesce(F.nullif("short", F.lit("")), "name"))


def matrix_report(
    commits: DataFrame, roster: DataFrame, scan: SmellScan, *, since: date | str | None = None,
    rules: Sequence[Rule] = SMELL_RULES, disabled: Sequence[str] = (),
) -> DataFrame:
    """Issue matrix of the visible authors with commits."""
    return issue_matrix(scan.counts, matrix_people(commits, roster, since=since), rules, disabled=disabled)


def matrix_sheets(
    commits: DataFrame, roster: DataFrame, scan: SmellScan, store: str, *, width: int = 10, since: date | str | None = None,
    rules: Sequence[Rule] = SMELL_RULES, disabled: Sequence[str] = (),
) -> DataFrame:
    """The issue matrix in sheets of ``width`` people, ordered by short name and address, until all are shown."""
    people = matrix_people(commits, roster, since=since).select("repo_id", "email", "short")
    matrix = issue_matrix(scan.counts, people, rules, disabled=disabled)
    return matrix_by_author(matrix, numbered(people, "repo_id", ["short", "email"], store, "place_no"), width)
