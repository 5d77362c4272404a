"""Rule scan over whole file texts.

The scan never shuffles: every file is judged where it is read.  A file is split
into lines once; each rule is tried only on files whose path is in scope and whose
text holds one of the rule's literal guards, so most rules cost one substring
search per file.  Only hits leave the scan, never file texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.paths import is_generated, path_matches, rule_path_sql
from repolens.functions.patterns import block_regex, guard_sql, line_regex, sql_string
from repolens.functions.suppression import DEFAULT_MARKERS, Markers, is_suppressed
from repolens.rules import LARGE_FILE_LINES, PACKS, SMELL, Rule

# Fixed value: a file with a longer line is machine-made.
MINIFIED_LINE_CHARS = 2000

FILE_ROW = "(file)"

HIT_FIELDS = {"rule_id": "string", "line_no": "int", "n": "int", "line": "string", "previous": "string"}

# Stands before each block match while lines are counted.  Neither sign is a word
# character, a space or punctuation, so exchanging them cannot change a match.
_MATCH_MARK = "\ue000"
_MARK_SUBSTITUTE = "\ufffd"


def split_lines(content: Column) -> Column:
    """All lines, with the empty one after a final newline."""
    return F.split(content, "\n", -1)


def pack_globs(family: str, packs: Iterable[str] | None = None) -> dict[str, tuple[str, ...]]:
    """Globs of each pack for one rule family."""
    return {
        pack_id: pack.smell_globs if family == SMELL else pack.security_globs
        for pack_id, pack in PACKS.items()
        if packs is None or pack_id in packs
    }


def listed_files(
    files: DataFrame, family: str, *, packs: Sequence[str] | None = None,
    globs: Sequence[str] | None = None, exclude: Sequence[str] = (),
) -> DataFrame:
    """Files a scan looks at: in a pack's globs, not generated, not excluded by the user."""
    return files.filter(is_listed(family, packs=packs, globs=globs, exclude=exclude))


def is_listed(
    family: str, *, packs: Sequence[str] | None = None, globs: Sequence[str] | None = None, exclude: Sequence[str] = (),
) -> Column:
    """Whether a scan looks at the row's ``path``."""
    wanted = globs if globs is not None else [g for gs in pack_globs(family, packs).values() for g in gs]
    path = F.col("path")
    return path_matches(path, wanted, folders=False) & ~is_generated(path) & ~path_matches(path, exclude)


def is_minified(content: Column) -> Column:
    """True where some line is too long to be handwritten; short texts are not split."""
    return (F.length(content) > MINIFIED_LINE_CHARS) & F.exists(
        split_lines(content), lambda line: F.length(line) > MINIFIED_LINE_CHARS)


def readable_files(listed: DataFrame) -> DataFrame:
    """Drop unreadable and minified files."""
    return listed.filter(is_readable())


def is_readable() -> Column:
    """Whether the row's ``content`` is there and written by hand."""
    return F.col("content").isNotNull() & ~is_minified(F.col("content"))


def file_packs(path: Column, family: str) -> Column:
    """Ids of the packs whose globs take in the path."""
    return F.array_compact(F.array(*(
        F.when(path_matches(path, globs, folders=False), F.lit(pack_id))
        for pack_id, globs in pack_globs(family).items())))


def _line_hits_sql(rule: Rule) -> str:
    return (
        f"transform(filter(numbered, x -> {guard_sql(rule, 'x.line', 'x.lowered')}"
        f" AND x.line RLIKE {sql_string(line_regex(rule))}), x -> struct({sql_string(rule.rule_id)} AS rule_id,"
        " x.line_no AS line_no, 1 AS n, x.line AS line, x.previous AS previous))"
    )


def _block_hits_sql(rule: Rule) -> str:
    """Mark the start of every match, then count the marks line by line."""
    mark = sql_string(_MATCH_MARK)
    marked = (
        f"split(regexp_replace(replace(content, {mark}, {sql_string(_MARK_SUBSTITUTE)}),"
        f" {sql_string(block_regex(rule))}, {sql_string(_MATCH_MARK + '$0')}), '\\n', -1)"
    )
    return (
        f"transform(filter(transform({marked}, (l, i) -> struct(i AS i,"
        f" length(l) - length(replace(l, {mark}, '')) AS n)), x -> x.n > 0),"
        f" x -> struct({sql_string(rule.rule_id)} AS rule_id, x.i + 1 AS line_no, x.n AS n,"
        " get(numbered, x.i).line AS line, get(numbered, x.i).previous AS previous))"
    )


def _rule_hits_sql(rule: Rule, scoped: bool) -> str:
    tried = f"{rule_path_sql(rule)} AND {guard_sql(rule, 'content', 'lowered')}"
    if scoped:
        packs = ", ".join(map(sql_string, rule.packs))
        tried = f"arrays_overlap(file_packs, array({packs})) AND {tried}"
    return f"CASE WHEN {tried} THEN {_block_hits_sql(rule) if rule.block else _line_hits_sql(rule)} END"


def scan_rules(
    files: DataFrame, rules: Sequence[Rule], *, markers: Markers = DEFAULT_MARKERS, scoped: bool = True,
    keep: Sequence[str] = (), file_rows: bool = False,
) -> DataFrame:
    """Hits of ``rules`` (of one family) in readable ``files`` (``repo_id, path, content``).

    One row per file, rule and line with ``n`` matches: 1 for a line rule, the number
    of matches starting there for a block rule; plus the ``line`` and the ``previous``
    one.  With ``scoped`` each rule stays inside the files of its packs; without, it
    runs on every given file.  Per-file columns named in ``keep`` are repeated on the
    hits.  With ``file_rows`` every file also yields one row with ``rule_id``
    ``FILE_ROW`` and its line count as ``line_no``: all a later job needs to know about
    the file without reading its text again.  No rules give no hits.
    """
    if not rules and not file_rows:
        return files.limit(0).select("repo_id", "path", *keep, *(
            F.lit(None).cast(kind).alias(name) for name, kind in HIT_FIELDS.items()))
    lowered = F.lower("content") if any(r.ignore_case for r in rules) else F.col("content")
    prepared = files.select(
        "repo_id", "path", "content", *keep, lowered.alias("lowered"),
        split_lines(F.col("content")).alias("lines"),
        file_packs(F.col("path"), rules[0].family if rules else SMELL).alias("file_packs"),
    )
    # The arrays are zipped, not looked up inside the lambda: a lookup would be inlined
    # and split the text again for every line.
    prepared = prepared.withColumn("numbered", F.expr(
        "transform(arrays_zip(lines, concat(array(''), lines), split(lowered, '\\n', -1)), (x, i) -> struct("
        "i + 1 AS line_no, x.lines AS line, x.`1` AS previous, x.`2` AS lowered))"))
    parts = [_rule_hits_sql(rule, scoped) for rule in rules]
    if file_rows:
        parts.append(
            f"array(struct({sql_string(FILE_ROW)} AS rule_id, cast(size(lines) AS int) AS line_no, 0 AS n,"
            " '' AS line, '' AS previous))")
    hits = ", ".join(parts)
    found = (
        prepared.select("repo_id", "path", *keep, F.expr(f"flatten(array_compact(array({hits})))").alias("hits"))
        # Outer, because Spark guards an inner generator with a filter that repeats the
        # whole scan expression.
        .select("repo_id", "path", *keep, F.inline_outer("hits"))
        .filter(F.col("rule_id").isNotNull())
    )
    return found.filter(~is_suppressed(F.col("line"), F.col("previous"), markers))


def line_count(content: Column) -> Column:
    """Number of lines, with the empty one after a final newline."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def file_facts(readable: DataFrame) -> DataFrame:
    """Line count of every readable file."""
    return readable.select("repo_id", "path", line_count(F.col("content")).cast("long").alias("n_lines"))


def facts_from_rows(rows: DataFrame) -> DataFrame:
    """The same from the file rows of a stored scan."""
    return rows.filter(F.col("rule_id") == FILE_ROW).select(
        "repo_id", "path", F.col("line_no").cast("long").alias("n_lines"))


def large_files(facts: DataFrame) -> DataFrame:
    """Files over the line limit."""
    return facts.filter(F.col("n_lines") > LARGE_FILE_LINES)


def scan_stats(listed: DataFrame) -> DataFrame:
    """Per repository: files listed (minified ones too) and readable files over the limit."""
    large = F.coalesce((line_count(F.col("content")) > LARGE_FILE_LINES) & ~is_minified(F.col("content")), F.lit(False))
    return listed.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(large).alias("large_files"))
