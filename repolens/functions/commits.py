"""Commit subjects, e-mail keys and activity grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.patterns import matches

# Subject patterns and the bands of the activity grade.
CONVENTIONAL_SUBJECT = r"^(feat|fix|refactor|chore|docs|style|test|perf|build|ci)(\(.+\))?:"
TICKET_REFERENCE = r"([A-Za-z]{2,}-\d+|#\d+)"
GIT_GRADE_BANDS = ((80, "A"), (72, "A-"), (66, "B+"), (58, "B"), (52, "B-"), (46, "C+"), (40, "C"), (34, "C-"))
GIT_GRADE_BASE, GIT_GRADE_VOLUME, GIT_GRADE_CONVENTIONAL, GIT_GRADE_TICKETS = 20, 35, 25, 20
FULL_VOLUME_COMMITS = 30
LOWEST_GRADE = "D"
WHITE_SPACE = " \t\n\r\x0b\x0c"


def email_key(email: Column) -> Column:
    """Join key of an e-mail address: case and outer blanks do not count."""
    return F.lower(F.btrim(email, F.lit(WHITE_SPACE)))


def is_conventional(subject: Column) -> Column:
    return F.coalesce(matches(subject, CONVENTIONAL_SUBJECT), F.lit(False))


def has_ticket(subject: Column) -> Column:
    return F.coalesce(matches(subject, TICKET_REFERENCE), F.lit(False))


def percentage(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(part / whole * 100)).otherwise(F.lit(0)).cast("int")


# A commit's second and author day in one BIGINT: unlike a struct or a max_by buffer it
# keeps the aggregate on hash tables instead of sorting every commit.
_DAY_SPAN, _DAY_OFFSET = 1_000_000, 500_000


def activity_key(commit_ts: Column, author_date: Column) -> Column:
    """Orders commits by commit time, then author day."""
    return F.unix_seconds(commit_ts) * _DAY_SPAN + F.unix_date(author_date) + _DAY_OFFSET


def activity_day(key: Column) -> Column:
    """The author day packed into an ``activity_key``."""
    return F.date_from_unix_date((F.pmod(key, F.lit(_DAY_SPAN)) - _DAY_OFFSET).cast("int"))


def latest_day(commit_ts: Column, author_date: Column) -> Column:
    """Author day of the latest commit (aggregate)."""
    return activity_day(F.max(activity_key(commit_ts, author_date)))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def git_grade(commits: Column, conv_pct: Column, ticket_pct: Column) -> Column:
    """Letter grade from sustained activity and commit hygiene."""
    score = (
        F.lit(float(GIT_GRADE_BASE))
        + F.least(commits / F.lit(float(FULL_VOLUME_COMMITS)), F.lit(1.0)) * GIT_GRADE_VOLUME
        + conv_pct / F.lit(100.0) * GIT_GRADE_CONVENTIONAL
        + ticket_pct / F.lit(100.0) * GIT_GRADE_TICKETS
    )
    grade = F.lit(LOWEST_GRADE)
    for floor, letter in reversed(GIT_GRADE_BANDS):
        grade = F.when(score >= floor, F.lit(letter)).otherwise(grade)
    return grade
