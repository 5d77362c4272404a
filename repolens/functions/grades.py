"""Code grade from weighted smells per owned line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.commits import LOWEST_GRADE

# Density bands per thousand lines and the smoothing constant.
CODE_GRADE_BANDS = ((1.5, "A"), (3.5, "A-"), (6.0, "B+"), (10.0, "B"), (15.0, "B-"), (22.0, "C+"), (30.0, "C"), (40.0, "C-"))
SMOOTHING_LINES = 500


def smell_density(score: Column, lines_owned: Column) -> Column:
    return score / (F.greatest(lines_owned, F.lit(0)) + SMOOTHING_LINES) * 1000


def code_grade(density: Column) -> Column:
    grade = F.lit(LOWEST_GRADE)
    for ceiling, letter in reversed(CODE_GRADE_BANDS):
        grade = F.when(density <= ceiling, F.lit(letter)).otherwise(grade)
    return grade


def chosen_grade(by_hand: Column, derived: Column) -> Column:
    """A grade set by hand wins; a blank one gives way to the derived grade."""
    return F.coalesce(F.nullif(by_hand, F.lit("")), derived)


def is_derived(by_hand: Column) -> Column:
    return F.coalesce(by_hand, F.lit("")) == ""
