"""Which lines are exempt: inline markers and sample credentials."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.patterns import matches


@dataclass(frozen=True)
class Markers:
    """Names of the comment directives that silence a line or the line below."""

    this_line: tuple[str, ...] = ("lens-ignore", "lens-disable-line")
    next_line: tuple[str, ...] = ("lens-disable-next-line",)


DEFAULT_MARKERS = Markers()


def _any_word(names: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(re.sub(r"([^\w-])", r"\\\1", n) for n in names) + r")\b"


def is_suppressed(line: Column, previous: Column, markers: Markers = DEFAULT_MARKERS) -> Column:
    """True where a marker stands on the line or a next-line marker on the previous one.

    A null previous line (the first line) counts as empty.
    """
    here = matches(line, _any_word(markers.this_line)) if markers.this_line else F.lit(False)
    above = matches(F.coalesce(previous, F.lit("")), _any_word(markers.next_line)) if markers.next_line else F.lit(False)
    return here | above


# Known sample logins, sample words and the comment test.
SAMPLE_LOGINS = r"rod\s*\/\s*koala|dianne\s*\/\s*emu|scott\s*\/\s*tiger"
SAMPLE_WORDS = r"\b(sample|example|dummy|placeholder)\b"
COMMENT_LINE = r"^\s*(<!--|\/\*|\*|\/\/|#)|-->|\*\/"
DOCUMENT_PATHS = r"\.(xml|md)$"


def is_sample_credential(line: Column, path: Column) -> Column:
    """Known sample logins anywhere; sample words only in comments and documents."""
    prose = matches(line, COMMENT_LINE) | matches(path, DOCUMENT_PATHS)
    return matches(line, SAMPLE_LOGINS, ignore_case=True) | (
        matches(line, SAMPLE_WORDS, ignore_case=True) & prose)
