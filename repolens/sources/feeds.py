"""External finding feeds: secret scanner and static analysis JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions.sast import sast_severity, sast_vector
from repolens.operators.findings import GITLEAKS, SECRETS, SEMGREP
from repolens.sources.git_export import report_repo
from repolens.sources.json_objects import read_json_objects

GITLEAKS_SCHEMA = (
    "RuleID STRING, Description STRING, File STRING, StartLine INT, Secret STRING, Match STRING, "
    "Author STRING, Email STRING"
)
SEMGREP_RESULT = (
    "check_id STRING, path STRING, start STRUCT<line: INT>, extra STRUCT<message: STRING, severity: STRING, "
    "metadata: STRUCT<category: STRING, cwe: ARRAY<STRING>, owasp: ARRAY<STRING>>>"
)

# Defaults, lengths and advice of feed findings.
DEFAULT_SECRET_RULE = "secret"
DEFAULT_SECRET_TEXT = "potential secret"
SECRET_SNIPPET_CHARS = 160
SECRET_FIX = (
    "Rotate the exposed credential immediately and purge it from git history (git filter-repo / BFG); load "
    "secrets from env/secret manager. (gitleaks scans full history — this may be in an old commit, not the "
    "current file.)"
)
DEFAULT_SAST_RULE = "rule"
SAST_SNIPPET_CHARS = 180
SAST_FIX = "Apply the remediation from this Semgrep rule (see its rule id / references)."


def _or(name: str, default: str) -> Column:
    """A null or empty value gives way to the default."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def normalise_gitleaks(raw: DataFrame) -> DataFrame:
    """Findings from raw secret rows (``repo_id``, the report's fields and an ``ordinal``).

    The first row per rule, file, line and secret (or match, or description) stays.
    """
    rule, line = _or("RuleID", DEFAULT_SECRET_RULE), F.coalesce("StartLine", F.lit(0))
    identity = F.coalesce(
        F.nullif("Secret", F.lit("")), F.nullif("Match", F.lit("")), F.nullif("Description", F.lit("")), F.lit(""))
    kept = raw.select(
        "repo_id", "ordinal", F.col("File").alias("path"), line.alias("line_no"), rule.alias("rule"),
        identity.alias("identity"), _or("Description", DEFAULT_SECRET_TEXT).alias("description"),
        _or("Author", "unknown").alias("author_name"), _or("Email", "").alias("author_email"))
    first = kept.groupBy("repo_id", "path", "line_no", "rule", "identity").agg(
        F.min_by(F.struct("description", "author_name", "author_email"), F.col("ordinal")).alias("first"))
    return first.select(
        "repo_id", F.lit(SECRETS).alias("vector"), F.concat(F.lit("gitleaks:"), "rule").alias("rule_id"), "path",
        "line_no", F.lit("High").alias("severity"),
        F.substring(F.concat("rule", F.lit(" — "), F.col("first.description")), 1, SECRET_SNIPPET_CHARS).alias("snippet"),
        F.lit(SECRET_FIX).alias("fix"), F.lit(True).alias("review"), F.col("first.author_name").alias("author_name"),
        F.col("first.author_email").alias("author_email"), F.lit(GITLEAKS).alias("source"))


def normalise_semgrep(raw: DataFrame) -> DataFrame:
    """Findings from raw static-analysis results (``repo_id`` and the result's fields)."""
    check = F.coalesce("check_id", F.lit(""))
    message = F.trim(F.regexp_replace(F.coalesce("extra.message", F.lit("")), r"\s+", " "))
    meta = "extra.metadata"
    return raw.select(
        "repo_id",
        sast_vector(F.col("check_id"), F.col("extra.message"), F.col(f"{meta}.category"), F.col(f"{meta}.cwe"),
                    F.col(f"{meta}.owasp")).alias("vector"),
        F.concat(F.lit("semgrep:"), F.coalesce(F.nullif("check_id", F.lit("")), F.lit(DEFAULT_SAST_RULE))).alias("rule_id"),
        "path", F.coalesce("start.line", F.lit(0)).alias("line_no"), sast_severity(F.col("extra.severity")).alias("severity"),
        F.substring(F.concat(F.element_at(F.split(check, r"\.", -1), -1), F.lit(": "), message), 1,
                    SAST_SNIPPET_CHARS).alias("snippet"),
        F.lit(SAST_FIX).alias("fix"), F.lit(True).alias("review"), F.lit("unknown").alias("author_name"),
        F.lit("").alias("author_email"), F.lit(SEMGREP).alias("source"))


def read_gitleaks_json(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """A secret report: one JSON array per file, of any length.  Without ``repo_id`` the reports of many
    repositories, each in a folder or a file of its repository's name.
    """
    objects = read_json_objects(spark, path, report_repo(spark, path, repo_id))
    return normalise_gitleaks(objects.select(
        "repo_id", F.struct("file", "object").alias("ordinal"), F.from_json("json", GITLEAKS_SCHEMA).alias("r")).select(
        "repo_id", "ordinal", "r.*"))


def read_semgrep_json(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """A static-analysis report: an object with a ``results`` array; many of them without ``repo_id``.

    A report of any length is read by byte ranges, and a result is a row as soon as it is found. Reference lists may also be single strings; both forms are read.
    """
    loose = SEMGREP_RESULT.replace("cwe: ARRAY<STRING>", "cwe: STRING").replace("owasp: ARRAY<STRING>", "owasp: STRING")
    objects = read_json_objects(spark, path, report_repo(spark, path, repo_id), "results")
    result = objects.select("repo_id", F.from_json("json", loose).alias("r")).select("repo_id", "r.*")
    extra = F.struct(
        F.col("extra.message").alias("message"), F.col("extra.severity").alias("severity"),
        F.struct(F.col("extra.metadata.category").alias("category"), _as_list("extra.metadata.cwe").alias("cwe"),
                 _as_list("extra.metadata.owasp").alias("owasp")).alias("metadata"))
    return normalise_semgrep(result.select(
        "repo_id", "check_id", "path", "start", extra.alias("extra")))


def _as_list(name: str) -> Column:
    """A JSON value read as text: a list stays a list, a single string becomes one."""
    value = F.col(name)
    return F.when(value.startswith("["), F.from_json(value, "array<string>")).otherwise(
        F.when(value.isNotNull(), F.array(value)))
