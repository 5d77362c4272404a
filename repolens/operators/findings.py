"""Security findings: scan, attribution, external feeds and clean-up."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.functions.paths import is_client_file, path_matches
from repolens.functions.patterns import matches, sql_string
from repolens.functions.report import clip
from repolens.functions.suppression import DEFAULT_MARKERS, Markers, is_sample_credential
from repolens.operators.attribution import attribute_hits
from repolens.operators.languages import present_packs
from repolens.operators.scan import FILE_ROW, file_packs, is_listed, is_readable, scan_rules
from repolens.operators.settings import allowed_hits, granted_packs
from repolens.operators.settings import drop_exempt as drop_exempt_by_repo
from repolens.operators.skew import join_per_repo
from repolens.rules import SECURITY, SECURITY_RULES, Rule, select_rules
from repolens.session import shared_folder

FINDING_COLUMNS = (
    "repo_id", "vector", "rule_id", "path", "line_no", "severity", "snippet", "fix", "review",
    "author_name", "author_email", "source", "rule_position",
)
BUILT_IN, GITLEAKS, SEMGREP = "built-in", "gitleaks", "semgrep"
SECRETS = "Secrets"

# The public client key and its advice.
CLIENT_KEY = r"AIza[0-9A-Za-z-_]{30,45}"
CLIENT_KEY_PREFIX = "AIza"
CLIENT_KEY_RULE = "gcp-api-key"
CLIENT_CONFIG_WORDS = r"firebase|authDomain"
CLIENT_KEY_TAG = "[Firebase/Web Client Key]"
CLIENT_KEY_FIX = (
    "Firebase / client-side Google API key is a public project identifier. Ensure HTTP referrer / package "
    "restrictions and Firebase Security Rules are enforced in Google Cloud Console; rotating is not required "
    "unless abused."
)


def _rule_facts_sql(rules: Sequence[Rule]) -> str:
    """Vector, severity and advice of the hit's rule, from a literal map (SQL text)."""

    def facts(position: int, rule: Rule) -> str:
        packs = ", ".join(map(sql_string, rule.packs))
        return (
            f"{sql_string(rule.rule_id)}, named_struct('vector', {sql_string(rule.vector or '')}, "
            f"'severity', {sql_string(rule.severity or '')}, 'fix', {sql_string(rule.fix or '')}, "
            f"'review', {str(rule.review).lower()}, 'rule_position', {position}, 'rule_packs', array({packs}))")

    if not rules:
        return ("cast(null as struct<vector: string, severity: string, fix: string, review: boolean, rule_position: int, "
                "rule_packs: array<string>>)")
    return f"element_at(map({', '.join(facts(i, r) for i, r in enumerate(rules))}), rule_id)"


def security_line_hits(
    files: DataFrame, rules: Sequence[Rule] = SECURITY_RULES, *, packs: Sequence[str] | None = None,
    globs: Sequence[str] | None = None, exclude: Sequence[str] = (), disabled: Sequence[str] = (),
    markers: Markers = DEFAULT_MARKERS, settings: DataFrame | None = None,
) -> DataFrame:
    """Unattributed built-in hits with their snippet.  With ``globs`` every rule runs on the files these name.

    ``settings`` are those of each repository (``operators.settings``), applied to the hits.

    Without ``packs`` the languages of each repository decide which rules reach its
    shared config files; with ``packs`` those apply to every repository, and a single
    pack runs all its rules on all its files.
    """
    return security_scan(
        files, rules, packs=packs, globs=globs, exclude=exclude, disabled=disabled, markers=markers, settings=settings, mentions=False)


def security_scan(
    files: DataFrame, rules: Sequence[Rule] = SECURITY_RULES, *, packs: Sequence[str] | None = None,
    globs: Sequence[str] | None = None, exclude: Sequence[str] = (), disabled: Sequence[str] = (),
    markers: Markers = DEFAULT_MARKERS, settings: DataFrame | None = None, mentions: bool = True,
) -> DataFrame:
    """The hits of :func:`security_line_hits`, and with ``mentions`` a row (rule ``FILE_ROW``) for each file of the repository, scanned or not,
    that mentions a public client configuration: all that later steps need to know of the texts, from one pass over them.
    """
    active = select_rules(rules, disabled=disabled, packs=packs)
    scanned = is_listed(SECURITY, packs=packs, globs=globs, exclude=exclude) & is_readable()
    if mentions:
        text = F.coalesce(_mentions_client(), F.lit(False))
        given = files.select("repo_id", "path", F.when(scanned, F.col("content")).alias("content"), text.alias("client_text"))
        given = given.filter("content IS NOT NULL OR client_text")
    else:  # only hits on a client key ask for it
        text = F.when(F.contains("content", F.lit(CLIENT_KEY_PREFIX)), _mentions_client()).otherwise(F.lit(False))
        given = files.filter(scanned).withColumn("client_text", text)
    hits = scan_rules(
        given, active, markers=markers, scoped=globs is None and (packs is None or len(packs) > 1), keep=["client_text"],
        file_rows=mentions)
    is_file = F.col("rule_id") == FILE_ROW
    hits = hits.filter(F.when(is_file, F.col("client_text")).otherwise(~is_sample_credential(F.col("line"), F.col("path")))).select(
        "repo_id", "path", "line_no", "rule_id", clip(F.col("line")).alias("snippet"), "client_text",
        F.expr(_rule_facts_sql(active)).alias("facts")).select("*", "facts.*").drop("facts")
    if packs is None and globs is None:
        granted = F.array_intersect(file_packs(F.col("path"), SECURITY), F.col("rule_packs"))
        present = present_packs(files) if settings is None else granted_packs(files, settings)
        hits = join_per_repo(hits, present, ["path"]).filter(is_file | F.arrays_overlap(granted, F.col("packs"))).drop("packs")
    if settings is not None:
        hits = allowed_hits(hits.filter(~is_file), settings, active, SECURITY).unionByName(hits.filter(is_file))
    return hits.drop("rule_packs")


def built_in_findings(hits: DataFrame, blame_lines: DataFrame, *, stored: bool = False) -> DataFrame:
    """Attribute the hits; lines without blame belong to ``unknown``."""
    return attribute_hits(hits, blame_lines, stored=stored).select(
        "repo_id", "vector", "rule_id", "path", "line_no", "severity", "snippet", "fix", "review",
        "author_name", F.coalesce("author_email", F.lit("")).alias("author_email"),
        F.lit(BUILT_IN).alias("source"), "rule_position", "client_text")


def merge_secret_feed(findings: DataFrame, feed: DataFrame) -> DataFrame:
    """Add a secret feed; it replaces built-in secrets on the same line, nothing else."""
    return without_taken(findings, feed).unionByName(feed, allowMissingColumns=True)


def without_taken(findings: DataFrame, feed: DataFrame) -> DataFrame:
    """Findings without the secrets on lines that the feed names."""
    taken = feed.select("repo_id", "path", "line_no", F.lit(SECRETS).alias("vector")).distinct()
    return findings.join(taken, ["repo_id", "path", "line_no", "vector"], "left_anti").select(findings.columns)


def attribute_feed(feed: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """Name the blame author of each feed finding; the feed has no address."""
    named = attribute_hits(feed.drop("author_name", "author_email"), blame_lines, stored=True)
    return named.withColumn("author_email", F.lit("")).select(feed.columns)


def drop_exempt(findings: DataFrame, *, exclude: Sequence[str] = (), disabled: Sequence[str] = ()) -> DataFrame:
    """Final filter over all sources: excluded paths, disabled rules, sample credentials."""
    kept = ~path_matches(F.col("path"), exclude) & ~is_sample_credential(F.col("snippet"), F.col("path"))
    if disabled:
        kept = kept & ~F.col("rule_id").isin(list(disabled))
    return findings.filter(kept)


def _mentions_client() -> Column:
    """Whether ``content`` mentions a public client configuration (plain substring search)."""
    lowered = F.lower("content")
    mentioned = F.lit(False)
    for word in CLIENT_CONFIG_WORDS.split("|"):
        mentioned = mentioned | F.contains(lowered, F.lit(word.lower()))
    return mentioned


def client_config_files(files: DataFrame) -> DataFrame:
    """Paths of files that mention a public client configuration."""
    return files.filter(_mentions_client()).select("repo_id", "path")


def downgrade_client_keys(findings: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Public client keys become Low.

    ``client_text`` says whether the finding's file mentions a client configuration.
    Where a feed left it null for a key, its files are searched, and no others.
    """
    snippet = F.col("snippet")
    is_key = matches(snippet, CLIENT_KEY) | F.contains("rule_id", F.lit(CLIENT_KEY_RULE))
    if files is not None:
        asked = findings.filter((F.col("vector") == SECRETS) & F.col("client_text").isNull() & is_key)
        named = files.join(asked.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
        mentioned = client_config_files(named).withColumn("mentioned", F.lit(True))
        findings = findings.join(mentioned, ["repo_id", "path"], "left").withColumn(
            "client_text", F.coalesce("client_text", "mentioned", F.lit(False))).drop("mentioned")
    public = (
        is_client_file(F.col("path")) | F.coalesce("client_text", F.lit(False))
        | matches(snippet, CLIENT_CONFIG_WORDS, ignore_case=True)
    )
    lowered = (F.col("vector") == SECRETS) & is_key & public
    tagged = F.when(snippet.startswith(CLIENT_KEY_TAG), snippet).otherwise(
        F.concat(F.lit(CLIENT_KEY_TAG + " "), snippet))
    return findings.withColumns({
        "severity": F.when(lowered, F.lit("Low")).otherwise(F.col("severity")),
        "review": F.when(lowered, F.lit(True)).otherwise(F.col("review")),
        "snippet": F.when(lowered, tagged).otherwise(snippet),
        "fix": F.when(lowered, F.lit(CLIENT_KEY_FIX)).otherwise(F.col("fix")),
    })


def security_findings(
    files: DataFrame, blame_lines: DataFrame, *, gitleaks: DataFrame | None = None,
    semgrep: DataFrame | None = None, rules: Sequence[Rule] = SECURITY_RULES,
    packs: Sequence[str] | None = None, globs: Sequence[str] | None = None, exclude: Sequence[str] = (),
    disabled: Sequence[str] = (), markers: Markers = DEFAULT_MARKERS, store: str | None = None,
    settings: DataFrame | None = None,
) -> DataFrame:
    """All findings of all engines.  Comment markers silence built-in rules only.

    Texts are read once: hits and mentions of client configurations are written to ``store``, a folder every executor sees (by
    default one in the shared folder). Everything else starts from these rows, and blame is joined once, for built-in
    hits and the SAST feed together, cut down to their lines.
    """
    spark = files.sparkSession
    store = store or f"{shared_folder(spark)}/security-hits-{uuid.uuid4().hex}"
    rows = security_scan(
        files, rules, packs=packs, globs=globs, exclude=exclude, disabled=disabled, markers=markers, settings=settings)
    rows.write.mode("overwrite").parquet(store)
    rows = spark.read.schema(rows.schema).parquet(store)
    mentions = rows.filter(F.col("rule_id") == FILE_ROW).select("repo_id", "path", F.lit(True).alias("mentioned"))
    lines = rows.filter(F.col("rule_id") != FILE_ROW).withColumn("source", F.lit(BUILT_IN))
    if gitleaks is not None:
        lines = without_taken(lines, gitleaks)
    if semgrep is not None:
        lines = lines.unionByName(semgrep.drop("author_name", "author_email"), allowMissingColumns=True)
    findings = attribute_hits(lines, blame_lines, stored=True).withColumn(
        "author_email", F.when(F.col("source") == BUILT_IN, F.coalesce("author_email", F.lit(""))).otherwise(""))
    if gitleaks is not None:
        findings = findings.unionByName(gitleaks, allowMissingColumns=True)
    findings = drop_exempt(findings, exclude=exclude, disabled=disabled)
    if settings is not None:
        findings = drop_exempt_by_repo(findings, settings)
    if gitleaks is not None:  # else a feed's keys are left as they are, as no key of its own was asked for
        asked = F.when(F.col("vector") == SECRETS, F.col("path"))
        findings = findings.withColumn("asked", asked).join(
            mentions.withColumnRenamed("path", "asked"), ["repo_id", "asked"], "left").withColumn(
            "client_text", F.coalesce("client_text", "mentioned", F.lit(False))).drop("asked", "mentioned")
    return downgrade_client_keys(findings).select(*FINDING_COLUMNS)
