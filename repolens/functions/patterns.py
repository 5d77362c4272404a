"""Regex dialect bridge.

Rules are written in the dialect common to scripting languages: ``\\b`` and ``\\w``
are ASCII, ``$`` is the end of the text, ``[`` is an ordinary character inside a
class.  ``spark_regex`` renders such a pattern for Spark's Java regex engine so
that it accepts the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column

from repolens.rules import Rule

_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

# A leading run of name characters never changes whether a line matches, and costs
# more than the rest of the pattern.
_OPTIONAL_NAME_PREFIX = "[A-Za-z0-9_-]*"

# Java recurses once per repetition of an ambiguous group and overflows the stack on
# long bodies.  Possessive groups loop instead.  This finds the same spans: a call,
# then balanced text, up to the last nested call that the balanced text reaches.
_BALANCED = r"(?:(?!\.subscribe\()(?:[^()]|\([^()]*+\)))*+"
_STACK_SAFE = {
    r"\.subscribe\((?:[^()]|\([^()]*\))*\.subscribe\(":
        rf"\.subscribe\({_BALANCED}\.subscribe(?:\([^()]*+\){_BALANCED}\.subscribe(?=\())*+\(",
}


def spark_regex(pattern: str, *, ignore_case: bool = False, dot_all: bool = False) -> str:
    """Render a portable pattern for ``rlike`` and friends."""
    pattern = _STACK_SAFE.get(pattern, pattern)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            pair = pattern[i:i + 2]
            out.append(_WORD_EDGE if pair == r"\b" and not in_class else pair)
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            out.append(r"\[" if ch == "[" else ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
        else:
            out.append(r"\z" if ch == "$" else ch)
        i += 1
    flags = "d" + ("i" if ignore_case else "") + ("s" if dot_all else "")
    return f"(?{flags}){''.join(out)}"


def matches(text: Column, pattern: str, *, ignore_case: bool = False, dot_all: bool = False) -> Column:
    """True where ``text`` contains a match of the portable ``pattern``."""
    return text.rlike(spark_regex(pattern, ignore_case=ignore_case, dot_all=dot_all))


def line_regex(rule: Rule) -> str:
    """The yes/no form of a line rule."""
    return spark_regex(rule.pattern.removeprefix(_OPTIONAL_NAME_PREFIX),
                       ignore_case=rule.ignore_case, dot_all=rule.dot_all)


def block_regex(rule: Rule) -> str:
    """The whole-text form of a block rule (match extents matter)."""
    return spark_regex(rule.pattern, ignore_case=rule.ignore_case, dot_all=rule.dot_all)


def sql_string(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def guard_sql(rule: Rule, text: str, lowered: str) -> str:
    """SQL condition: the text may hold a match, as at least one guard literal occurs."""
    if not rule.guards:
        return "true"
    if rule.ignore_case:
        found = [f"contains({lowered}, {sql_string(g.lower())})" for g in rule.guards]
    else:
        found = [f"contains({text}, {sql_string(g)})" for g in rule.guards]
    return "(" + " OR ".join(found) + ")"
