"""Small formatting expressions of the report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.rules import SEVERITIES, VECTORS

# Limits and shades of the report.
STALE_DAYS = 21
SNIPPET_CHARS = 160
HEAT_FLOOR, HEAT_SPAN = 0.15, 0.85
CELL_FLOOR, CELL_SPAN, CELL_FULL, CELL_CEILING = 0.06, 0.7, 55, 0.7
FULL_NAME_PREFIXES = ("M. ", "S. ")


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def clip(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    """Stripped text, cut to ``limit`` characters with an ellipsis."""
    bare = strip(text)
    return F.when(F.length(bare) > limit, F.concat(F.substring(bare, 1, limit), F.lit("…"))).otherwise(bare)


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def vector_rank(vector: Column) -> Column:
    rank = F.lit(len(VECTORS))
    for i, name in enumerate(VECTORS):
        rank = F.when(vector == name, F.lit(i)).otherwise(rank)
    return rank


def month_label(month: Column, through: Column) -> Column:
    """``Jul``, or ``Jul '25`` for a month outside the year of the report date."""
    name = F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMM")
    year = F.substring(month, 1, 4)
    return F.when(year == F.date_format(through, "yyyy"), name).otherwise(
        F.concat(name, F.lit(" '"), F.substring(month, 3, 2)))


def to_fixed(value: Column, digits: int) -> Column:
    """Text of a positive double with fixed decimals, rounded by its exact binary value.

    ``round`` looks at the shortest decimal text instead and turns 0.575, which is
    stored a little below, into 0.58.  Exact halves round up.
    """
    is_half = F.pmod(value * 2 ** (digits + 1), F.lit(2.0)) == 1
    return F.call_function(
        "format_number", F.when(is_half, value + 1e-9).otherwise(value), F.lit("0." + "0" * digits))


def heat_intensity(commits: Column, busiest: Column) -> Column:
    """Shade of a month cell; null for an empty one."""
    return F.when(commits > 0, to_fixed(HEAT_FLOOR + HEAT_SPAN * (commits / busiest), 2).cast("double"))


def cell_intensity(cell: Column) -> Column:
    """Shade of a matrix cell from the digits in it; null for a clean one."""
    n = F.coalesce(F.nullif(F.regexp_replace(cell.cast("string"), "[^0-9]", ""), F.lit("")), F.lit("0")).cast("long")
    return F.when(n > 0, to_fixed(
        F.least(CELL_FLOOR + n / F.lit(CELL_FULL) * CELL_SPAN, F.lit(CELL_CEILING)), 2).cast("double"))


def format_k(n: Column) -> Column:
    """Thousands as ``1.2k``."""
    return F.when(n >= 1000, F.concat(to_fixed(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))


def grade_class(grade: Column) -> Column:
    """First letter of a grade, ``x`` for none."""
    letter = F.substring(F.coalesce(grade, F.lit("")), 1, 1)
    return F.when(letter.isin("A", "B", "C", "D"), F.lower(letter)).otherwise(F.lit("x"))


def is_stale(last_active: Column, through: Column) -> Column:
    """More than three weeks without a commit; null without any."""
    return F.datediff(through, last_active) > STALE_DAYS


def short_name(name: Column) -> Column:
    """First word, unless the name starts with a kept initial."""
    kept = F.lit(False)
    for prefix in FULL_NAME_PREFIXES:
        kept = kept | name.startswith(prefix)
    return F.when(kept, name).otherwise(F.element_at(F.split(name, " "), 1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
