"""Weighted smell scores, grades and the issue matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.grades import chosen_grade, code_grade, is_derived, smell_density
from repolens.functions.report import cell_intensity
from repolens.operators.commits import with_git_grade
from repolens.operators.skew import join_per_repo
from repolens.rules import LARGE_LABEL, LARGE_RULE_ID, LARGE_WEIGHT, SMELL_RULES, Rule


def smell_weight(rule_id: Column, rules: Sequence[Rule] = SMELL_RULES) -> Column:
    """Weight of a smell; 1 for an unknown one."""
    weight = F.lit(1)
    for value in sorted({r.weight for r in rules} | {LARGE_WEIGHT}):
        ids = [r.rule_id for r in rules if r.weight == value]
        if value == LARGE_WEIGHT:
            ids.append(LARGE_RULE_ID)
        weight = F.when(rule_id.isin(ids), F.lit(value)).otherwise(weight)
    return weight


def code_grades(counts: DataFrame, owned: DataFrame, rules: Sequence[Rule] = SMELL_RULES) -> DataFrame:
    """Score, density and grade of every author who owns lines or has hits."""
    scores = counts.groupBy("repo_id", "email").agg(
        F.sum(F.col("n") * smell_weight(F.col("rule_id"), rules)).alias("score"))
    joined = owned.join(scores, ["repo_id", "email"], "full").select(
        "repo_id", "email", F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("lines_owned", F.lit(0)).alias("lines_owned"))
    density = smell_density(F.col("score"), F.col("lines_owned"))
    return joined.withColumn("density", density).withColumn("derived_code_grade", code_grade(F.col("density")))


def final_grades(roster: DataFrame, metrics: DataFrame, grades: DataFrame | None) -> DataFrame:
    """Grades of the roster: set by hand, else derived; ``auto_*`` tells which.

    Without a code scan a blank code grade stays null.
    """
    out = roster.join(
        with_git_grade(metrics).select("repo_id", "email", "derived_git_grade"), ["repo_id", "email"], "left")
    idle = F.lit("D")  # the grade of no commits at all
    git = F.coalesce("derived_git_grade", idle)
    if grades is None:
        code, scanned = F.lit(None).cast("string"), F.lit(False)
    else:
        out = out.join(grades.select("repo_id", "email", "derived_code_grade"), ["repo_id", "email"], "left")
        code, scanned = F.coalesce("derived_code_grade", F.lit("A")), F.lit(True)
    return out.select(
        "repo_id", "email", "name",
        chosen_grade(F.col("git_grade"), git).alias("git_grade"),
        chosen_grade(F.col("code_grade"), code).alias("code_grade"),
        is_derived(F.col("git_grade")).alias("auto_git"),
        (is_derived(F.col("code_grade")) & scanned).alias("auto_code"),
    )


def matrix_rows(rules: Sequence[Rule], disabled: Sequence[str] = ()) -> list[tuple[int, str, str]]:
    """Position, id and label of every matrix row; large files come last."""
    rows = [(i, r.rule_id, r.label) for i, r in enumerate(rules) if r.rule_id not in disabled]
    if LARGE_RULE_ID not in disabled:
        rows.append((len(rules), LARGE_RULE_ID, LARGE_LABEL))
    return rows


def issue_matrix(
    counts: DataFrame, card_authors: DataFrame, rules: Sequence[Rule] = SMELL_RULES, *,
    disabled: Sequence[str] = (),
) -> DataFrame:
    """Long form: one row per card author and rule, 0 where there are no hits.

    The rules come from the driver and are exploded on each author row, so the
    scaffold needs no product join.
    """
    rows = F.array(*(
        F.struct(F.lit(i).alias("position"), F.lit(rule_id).alias("rule_id"), F.lit(label).alias("label"))
        for i, rule_id, label in matrix_rows(rules, disabled)))
    scaffold = card_authors.select("repo_id", "email", "short", F.inline(rows))
    return (
        scaffold.join(counts, ["repo_id", "email", "rule_id"], "left")
        .select("repo_id", "email", "short", "position", "rule_id", "label",
                F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("intensity", cell_intensity(F.col("n")))
    )


def matrix_by_rule(matrix: DataFrame, rules: Sequence[Rule] = SMELL_RULES, *, disabled: Sequence[str] = ()) -> DataFrame:
    """Authors as rows, rules as columns: a fixed set of columns for any number of authors."""
    ids = [rule_id for _, rule_id, _ in matrix_rows(rules, disabled)]
    return matrix.groupBy("repo_id", "email", "short").pivot("rule_id", ids).agg(F.first("n"))


def matrix_by_author(matrix: DataFrame, people: DataFrame, width: int) -> DataFrame:
    """Rules as rows, people as columns: sheets of ``width`` people each, as many as it takes to show everybody.

    ``people`` has ``repo_id, email`` and the person's number ``place_no`` in the repository, from 1 (:func:`.numbering.numbered`). Column
    ``p0`` is the first person of the sheet and so on; places after the last person are null. ``people`` lists the sheet's names.
    """
    number = F.col("place_no") - 1
    sheet, place = F.floor(number / width).cast("int"), F.pmod(number, F.lit(width)).cast("int")
    placed = people.select("repo_id", "email", sheet.alias("sheet"), place.alias("place"))
    cells = matrix.join(placed, ["repo_id", "email"])
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("place", "short"))), lambda p: p["short"]), ", ")
    key = ["repo_id", "sheet", "position", "rule_id", "label"]
    wide = cells.groupBy(*key).agg(
        names.alias("people"), *[F.sum(F.when(F.col("place") == p, F.col("n"))).alias(f"p{p}") for p in range(width)])
    return wide


def matrix_override(matrix: DataFrame, by_hand: DataFrame | None) -> DataFrame:
    """Repositories with a matrix written by hand show that one, the others the derived one.

    ``by_hand`` has ``repo_id, position, label, short, cell``; cells may be any text.
    """
    cells = matrix.select("repo_id", "position", "label", "short", F.col("n").cast("string").alias("cell"))
    if by_hand is not None:
        written = by_hand.select("repo_id", F.lit(True).alias("written")).distinct()
        derived = join_per_repo(cells, written, ["label", "short"], "left").filter(F.col("written").isNull()).drop("written")
        cells = derived.unionByName(by_hand)
    return cells.withColumn("intensity", cell_intensity(F.col("cell")))
