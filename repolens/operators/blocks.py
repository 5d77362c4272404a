"""Block rules of a user's own, matched outside the Java engine.

A pattern that somebody writes may take Java's engine exponential time or all of its stack. Here texts go through Arrow batches to a
matcher without backtracking (RE2), whose time grows with the text alone. A pattern that it does not take, one that looks around or
back, is tried by a backtracking engine under a time limit for each file. What cannot be matched becomes a row that says
why; no task dies of a pattern.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions.suppression import DEFAULT_MARKERS, Markers, is_suppressed
from repolens.rules import Rule

#: Stand before each match while lines are counted, and in the place of a text's own mark.
MARK, SUBSTITUTE = "\ue000", "\ufffd"
#: Seconds that one rule may take on one file where its pattern needs backtracking.
SECONDS = 10.0
#: Characters of texts that are matched at once, one long text aside.
CHARS = 4_000_000

HITS = "repo_id STRING, path STRING, rule_id STRING, line_no INT, n INT, line STRING, previous STRING, error STRING"


def portable(pattern: str, end: str) -> str:
    """The pattern with its ``$`` as the end of the text and ``[`` in a class as an ordinary character."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            out.append("\\[" if ch == "[" else ch)
        else:
            in_class = ch == "["
            out.append(end if ch == "$" else ch)
        i += 1
    return "".join(out)


class Matcher:
    """Marks the beginning of every match of one rule's pattern."""

    def __init__(self, rule: Rule, seconds: float):
        self.rule, self.seconds, self.error = rule, seconds, None
        flags = ("i" if rule.ignore_case else "") + ("s" if rule.dot_all else "")
        self._linear = (f"(?{flags})" if flags else "") + f"({portable(rule.pattern, chr(92) + 'z')})"
        self._bounded = None
        try:
            pc.replace_substring_regex(pa.array([""]), self._linear, MARK)
        except pa.ArrowInvalid:  # not a pattern for this matcher
            options = regex.ASCII | regex.IGNORECASE * rule.ignore_case | regex.DOTALL * rule.dot_all
            try:
                self._bounded = regex.compile(portable(rule.pattern, r"\Z"), options)
            except regex.error as wrong:
                self.error = f"pattern: {wrong}"

    def marked(self, texts: list[str]) -> Iterator[tuple[str | None, str | None]]:
        """Each text with its marks, or null and what went wrong."""
        if self.error:
            yield from ((None, self.error) for _ in texts)
        elif self._bounded is None:
            for found in pc.replace_substring_regex(pa.array(texts, pa.large_string()), self._linear, MARK + r"\1").to_pylist():
                yield found, None
        else:
            for text in texts:
                try:
                    yield self._bounded.sub(lambda m: MARK + m[0], text, timeout=self.seconds), None
                except TimeoutError:
                    yield None, f"no result within {self.seconds:g} s"


def block_hits(path: str, text: str, marked: str) -> Iterator[tuple[int, int, str, str]]:
    """``(line_no, n, line, previous)`` of each line in which matches begin."""
    lines = text.split("\n")
    for i, piece in enumerate(marked.split("\n")):
        n = piece.count(MARK)
        if n:
            yield i + 1, n, lines[i], lines[i - 1] if i else ""


def scan_blocks(
    files: DataFrame, rules: Sequence[Rule], *, markers: Markers = DEFAULT_MARKERS, seconds: float = SECONDS,
) -> DataFrame:
    """Hits of block rules in readable ``files`` (``repo_id, path, content``), as :func:`.scan.scan_rules` finds them.

    One row per file, rule and line with the number of matches that begin there, and a row with ``error`` (no line, no matches) for
    each file that a rule could not be matched against. Null texts have no rows; a rule's own path patterns hold. Matches do not
    overlap; an empty one counts where it stands. Texts go to Python once for all rules.
    """
    rules = list(rules)
    if any(not r.block for r in rules):
        raise ValueError("line rules are scanned by scan_rules")
    names = [f.split(" ")[0] for f in HITS.split(", ")]
    kinds = [pa.int32() if "INT" in f else pa.string() for f in HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(r, seconds) for r in rules]
        scopes = [(_path_test(r.path_include, r.path_include_ignore_case), _path_test(r.path_exclude, r.path_exclude_ignore_case)) for r in rules]
        for batch in batches:
            for rows in _some(batch):
                out = []
                for matcher, (inside, outside) in zip(matchers, scopes, strict=True):
                    rule = matcher.rule
                    tried = [
                        (repo, path, text) for repo, path, text in rows
                        if (inside is None or inside.search(path)) and (outside is None or not outside.search(path)) and _guarded(rule, text)]
                    for (repo, path, text), (marked, error) in zip(tried, matcher.marked([t for *_, t in tried]), strict=True):
                        if error:
                            out.append((repo, path, rule.rule_id, None, 0, None, None, error))
                        elif len(marked) > len(text):
                            out += [(repo, path, rule.rule_id, *hit, None) for hit in block_hits(path, text, marked)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    content = F.replace("content", F.lit(MARK), F.lit(SUBSTITUTE))
    given = files.filter("path IS NOT NULL AND content IS NOT NULL").select("repo_id", "path", content.alias("content"))
    found = given.mapInArrow(run, HITS)
    return found.filter(F.col("error").isNotNull() | ~F.coalesce(is_suppressed(F.col("line"), F.col("previous"), markers), F.lit(False)))


def _path_test(pattern: str | None, ignore_case: bool) -> regex.Pattern | None:
    return regex.compile(portable(pattern, r"\Z"), regex.ASCII | regex.IGNORECASE * ignore_case) if pattern else None


def _guarded(rule: Rule, text: str) -> bool:
    if not rule.guards:
        return True
    if rule.ignore_case:
        lowered = text.lower()
        return any(g.lower() in lowered for g in rule.guards)
    return any(g in text for g in rule.guards)


def _some(batch: pa.RecordBatch) -> Iterator[list[tuple[str, str, str]]]:
    rows, size = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        rows.append(row)
        size += len(row[2])
        if size >= CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows
