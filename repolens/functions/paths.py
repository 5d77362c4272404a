"""Path globs and the fixed generated-file filter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.patterns import matches, spark_regex, sql_string
from repolens.rules import EXTENSION_LANGUAGE, Rule

# Vendored, generated, test and build-output paths.
GENERATED_PATHS = (
    r"(node_modules|\.spec\.|\.test\.|\.d\.ts$|dist\/|build\/|coverage\/|\.min\.|\.bundle\.|package-lock"
    r"|\.map$|\/assets\/|charting_library|tradingview|vendor\/|polyfill)"
)
UNCOUNTED_PATHS = r"node_modules|\.d\.ts$"
CLIENT_FILE_PATHS = r"\.(ts|tsx|js|jsx|html|vue)$"
CLIENT_FILE_HINT = r"environment"


def glob_to_regex(glob: str, folders: bool = True) -> str | None:
    """Regex (Java and RE2) for one path glob, or None for a blank one.

    ``*`` and ``?`` stay inside a path segment, ``**`` crosses segments, a trailing
    slash means everything below.  A glob may start at any segment; with ``folders`` it
    may end at any, so that it takes in what lies below a folder of that name.
    """
    glob = glob.strip().replace("\\", "/").removeprefix("./")
    if not glob:
        return None
    if glob.endswith("/"):
        glob += "**"
    parts = []
    for i, stretch in enumerate(glob.split("**")):
        if i:
            parts.append(".*")
        for ch in stretch:
            if ch == "*":
                parts.append("[^/]*")
            elif ch == "?":
                parts.append("[^/]")
            elif ch in ".+^${}()|[]":
                parts.append("\\" + ch)
            else:
                parts.append(ch)
    return f"(^|/){''.join(parts)}{'($|/)' if folders else '$'}"


def globs_to_regex(globs: Iterable[str], folders: bool = True) -> str | None:
    """One alternation for a list of globs, without repeats (None when empty)."""
    regexes = [r for g in dict.fromkeys(globs) if (r := glob_to_regex(g, folders))]
    return "|".join(regexes) if regexes else None


def globs_column_to_regex(globs: Column) -> Column:
    """:func:`globs_to_regex` for a column of glob lists: one alternation a row, null for no globs.

    Each repository has its own list, so the regex is data: it is made where the list is read.
    """
    def literal(text: Column) -> Column:
        escaped = F.regexp_replace(text, r"([.+^${}()|\[\]])", r"\\$1")
        return F.replace(F.replace(escaped, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))

    def regex(glob: Column) -> Column:
        bare = F.regexp_replace(F.translate(F.regexp_replace(glob, r"^\s+|\s+$", ""), "\\", "/"), r"^\./", "")
        whole = F.when(bare.endswith("/"), F.concat(bare, F.lit("**"))).otherwise(bare)
        stretches = F.transform(F.split(whole, r"\*\*", -1), literal)
        return F.when(bare != "", F.concat(F.lit("(^|/)"), F.array_join(stretches, ".*"), F.lit("($|/)")))

    each = F.array_distinct(F.array_compact(F.transform(F.array_compact(globs), regex)))
    return F.when(F.size(each) > 0, F.array_join(each, "|"))


def normalise_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``; the usual path passes two cheap tests only."""
    unusual = F.contains(path, F.lit("\\")) | path.startswith("./")
    return F.when(unusual, F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")).otherwise(path)


def path_matches(path: Column, globs: Iterable[str], folders: bool = True) -> Column:
    """True where the path matches one of the globs; False for no globs or a null path."""
    regex = globs_to_regex(globs, folders)
    if regex is None:
        return F.lit(False)
    return F.coalesce(matches(normalise_path(path), regex), F.lit(False))


def is_generated(path: Column) -> Column:
    return matches(path, GENERATED_PATHS, ignore_case=True)


def is_client_file(path: Column) -> Column:
    return matches(path, CLIENT_FILE_PATHS, ignore_case=True) | matches(
        path, CLIENT_FILE_HINT, ignore_case=True)


def rule_path_sql(rule: Rule, path: str = "path") -> str:
    """SQL condition: the rule's own include and exclude patterns allow the path."""
    tests = []
    if rule.path_include:
        regex = spark_regex(rule.path_include, ignore_case=rule.path_include_ignore_case)
        tests.append(f"{path} RLIKE {sql_string(regex)}")
    if rule.path_exclude:
        regex = spark_regex(rule.path_exclude, ignore_case=rule.path_exclude_ignore_case)
        tests.append(f"NOT {path} RLIKE {sql_string(regex)}")
    return "(" + " AND ".join(tests or ["true"]) + ")"


def language_of(path: Column) -> Column:
    """Language by file extension; null when unknown or not counted."""
    extension = F.element_at(F.split(path, r"\.", -1), -1)
    language = F.lit(None).cast("string")
    for lang in dict.fromkeys(EXTENSION_LANGUAGE.values()):
        known = [e for e, l in EXTENSION_LANGUAGE.items() if l == lang]
        language = F.when(extension.isin(known), F.lit(lang)).otherwise(language)
    return F.when(~matches(path, UNCOUNTED_PATHS), language)


def repo_name(remote_url: Column) -> Column:
    """Last segment of a remote URL without a ``.git`` ending."""
    bare = F.regexp_replace(F.regexp_replace(remote_url, r"\.git$", ""), r"/+$", "")
    return F.element_at(F.split(bare, "/", -1), -1)
