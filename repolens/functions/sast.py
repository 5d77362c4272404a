"""Mapping of an external static-analysis feed onto vectors and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens.functions.patterns import matches
from repolens.rules import SAST_OTHER

# Keyword routing (first match wins) and severity names.
VECTOR_KEYWORDS = (
    (r"xss|cross-site|innerhtml|sanitiz|dom-based|trustedhtml", "Injection/XSS"),
    (r"sql|nosql|injection|command|ssti|template-?injection|\beval\b|deserial", "Injection/XSS"),
    (r"redos|regular expression|catastrophic|\bregex\b", "ReDoS"),
    (r"clipboard|paste", "Clipboard"),
    (r"\bdos\b|denial[- ]of[- ]service|payload size|size limit", "LPDoS"),
)
SEVERITY_NAMES = {"ERROR": "High", "WARNING": "Medium", "INFO": "Low"}
DEFAULT_SEVERITY = "Medium"


def sast_vector(check_id: Column, message: Column, category: Column, cwe: Column, owasp: Column) -> Column:
    """Route a result by the words in its id, message, category and references."""
    blank = F.lit("")
    text = F.lower(F.concat_ws(
        " ", F.coalesce(check_id, blank), F.coalesce(message, blank), F.coalesce(category, blank),
        F.coalesce(F.array_join(cwe, " "), blank), F.coalesce(F.array_join(owasp, " "), blank)))
    vector = F.lit(SAST_OTHER)
    for keywords, name in reversed(VECTOR_KEYWORDS):
        vector = F.when(matches(text, keywords), F.lit(name)).otherwise(vector)
    return vector


def sast_severity(severity: Column) -> Column:
    mapped = F.lit(DEFAULT_SEVERITY)
    for name, ours in SEVERITY_NAMES.items():
        mapped = F.when(severity == name, F.lit(ours)).otherwise(mapped)
    return mapped
