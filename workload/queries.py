"""One query per operator, over whole staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions.commits import has_ticket, is_conventional, percentage
from repolens.functions.paths import is_generated, normalise_path, path_matches, repo_name
from repolens.functions.report import cell_intensity
from repolens.functions.suppression import is_sample_credential, is_suppressed
from repolens.operators import attribution, authors, blame_runs, cadence, commits, delta, findings, languages, ranking, scan, scoring
from repolens.operators.blocks import scan_blocks
from repolens.operators.settings import in_own_period
from repolens.plans import author_report as reports
from repolens.plans import delta_report as deltas
from repolens.plans.security_report import stored_findings
from repolens.rules import LARGE_RULE_ID, PACKS, SECURITY, SECURITY_RULES, SMELL, SMELL_RULES, Rule
from repolens.session import shared_folder
from repolens.sources import feeds, git_export
from repolens.sources.config import roster_from_authors
from repolens.sources.files import read_file_bytes
from repolens.sources.snapshots import latest_snapshot, read_snapshots
from repolens.streaming import feeds as streams
from workload.staging import DISABLED, EXCLUDE, PERIOD_START, Staged, export_files, export_reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Staged], DataFrame]) -> Callable[[Staged], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Staged(spark, sf_dir))
    return build


# --- sources ---------------------------------------------------------------


@query
def src_commit_log(s: Staged) -> DataFrame:
    return git_export.parse_commit_log(s.log_text).select(
        "repo_id", "sha", "author_name", "author_email", "author_date", F.to_date("commit_ts").alias("commit_date"), "subject")


@query
def src_numstat(s: Staged) -> DataFrame:
    return git_export.parse_numstat(s.log_text)


@query
def src_blame(s: Staged) -> DataFrame:
    return git_export.parse_blame(s.blame_text)


@query
def src_gitleaks(s: Staged) -> DataFrame:
    return feeds.normalise_gitleaks(s.gitleaks_raw)


@query
def src_semgrep(s: Staged) -> DataFrame:
    return feeds.normalise_semgrep(s.semgrep_raw)


@query
def src_roster(s: Staged) -> DataFrame:
    return s.roster_from_config().drop("badge", "highlight")


@query
def src_files(s: Staged) -> DataFrame:
    """The texts written as files of several repositories and read back as bytes; each repository has a file that is no text."""
    folder = _folder(s, "exported-files")
    export_files(s.files, folder)
    return read_file_bytes(s.spark, folder).select("repo_id", "path", "n_bytes", F.sha2("content", 256).alias("sha256"), "problem")


@query
def src_gitleaks_files(s: Staged) -> DataFrame:
    """Secret reports of all repositories, written as JSON documents and read back."""
    folder = _folder(s, "secret-reports")
    export_reports(s.gitleaks_raw, folder, ["ordinal", "File"], "[", "]")
    return feeds.read_gitleaks_json(s.spark, folder).withColumn("repo_id", F.regexp_replace("repo_id", "^repo_id=", ""))


@query
def src_semgrep_files(s: Staged) -> DataFrame:
    """Analysis reports of all repositories, among members that look like results, written as JSON documents and read back."""
    folder = _folder(s, "sast-reports")
    begin = r'{"version": "1}{ \"results\": [", "errors": [{"results": [{"check_id": "no"}]}], "time": {"a": {}, "results": [{}]}, "results": ['
    export_reports(s.semgrep_raw, folder, ["path", "check_id"], begin, '], "skipped": [{"check_id": "no"}, {"check_id": "no"}]}')
    return feeds.read_semgrep_json(s.spark, folder).withColumn("repo_id", F.regexp_replace("repo_id", "^repo_id=", ""))


# --- filters and scalar functions -------------------------------------------


@query
def path_exclusion(s: Staged) -> DataFrame:
    return (
        s.commit_files.filter(~path_matches(F.col("path"), EXCLUDE))
        .groupBy(normalise_path(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    )


@query
def generated_exclusion(s: Staged) -> DataFrame:
    return s.files.select("repo_id", "path").filter(~is_generated(F.col("path")))


@query
def minified_filter(s: Staged) -> DataFrame:
    return scan.readable_files(s.files).select("repo_id", "path")


def _numbered_lines(files: DataFrame) -> DataFrame:
    lines = scan.split_lines(F.col("content"))
    pairs = F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit("")), lines).alias("previous"))
    return files.select("repo_id", "path", F.posexplode(pairs)).select(
        "repo_id", "path", (F.col("pos") + 1).alias("line_no"), "col.line", "col.previous").filter("line is not null")


@query
def inline_suppression(s: Staged) -> DataFrame:
    lines = _numbered_lines(s.files)
    return lines.filter(is_suppressed(F.col("line"), F.col("previous"))).select("repo_id", "path", "line_no")


@query
def sample_credential_filter(s: Staged) -> DataFrame:
    lines = _numbered_lines(s.files)
    return lines.filter(is_sample_credential(F.col("line"), F.col("path"))).select("repo_id", "path", "line_no")


@query
def disabled_rules(s: Staged) -> DataFrame:
    found = reports.smell_scan(s.files, s.blame_lines, disabled=DISABLED)
    return found.counts


@query
def period_filter(s: Staged) -> DataFrame:
    return commits.author_metrics(s.commits, PERIOD_START)


@query
def active_authors(s: Staged) -> DataFrame:
    recent = commits.author_metrics(s.commits, PERIOD_START).select("repo_id", "email", "commits")
    people = authors.dedupe_roster(s.roster).select("repo_id", "email")
    return authors.active_authors(people.join(recent, ["repo_id", "email"], "left").na.fill(0, ["commits"]))


@query
def conventional_pct(s: Staged) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count_if(is_conventional(F.col("subject")))
    return s.commits.groupBy("repo_id").agg(n.alias("commits"), k.alias("conv"), percentage(k, n).alias("conv_pct"))


@query
def ticket_pct(s: Staged) -> DataFrame:
    n, k = F.count(F.lit(1)), F.count_if(has_ticket(F.col("subject")))
    return s.commits.groupBy("repo_id").agg(n.alias("commits"), k.alias("tickets"), percentage(k, n).alias("ticket_pct"))


@query
def git_grade(s: Staged) -> DataFrame:
    return commits.with_git_grade(commits.author_metrics(s.commits)).select("repo_id", "email", "derived_git_grade")


@query
def repo_dim(s: Staged) -> DataFrame:
    return s.repos.select("repo_id", "remote_url", repo_name(F.col("remote_url")).alias("repo_name"))


@query
def sast_vector_map(s: Staged) -> DataFrame:
    return feeds.normalise_semgrep(s.semgrep_raw).groupBy("rule_id", "vector", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- commit analytics --------------------------------------------------------


@query
def author_metrics(s: Staged) -> DataFrame:
    return commits.author_metrics(s.commits)


@query
def discover_authors(s: Staged) -> DataFrame:
    return commits.discover_authors(s.commits)


@query
def line_churn(s: Staged) -> DataFrame:
    return commits.line_churn(s.commits, s.commit_files, exclude=EXCLUDE)


@query
def monthly_cadence(s: Staged) -> DataFrame:
    return commits.monthly_cadence(s.commits)


@query
def last_active(s: Staged) -> DataFrame:
    return commits.author_metrics(s.commits).select("repo_id", "email", "last_active")


@query
def date_bounds(s: Staged) -> DataFrame:
    return commits.date_bounds(s.commits)


def _reported(s: Staged, rows: DataFrame) -> DataFrame:
    return authors.reported(rows, authors.dedupe_roster(s.roster))


def _heatmap(s: Staged) -> DataFrame:
    months = _reported(s, commits.monthly_cadence(s.commits))
    return cadence.month_heatmap(months, commits.date_bounds(s.commits))


@query
def month_heatmap_history(s: Staged) -> DataFrame:
    """The heat map of everybody who committed, on the roster or not."""
    return cadence.month_heatmap(commits.monthly_cadence(s.commits), commits.date_bounds(s.commits))


@query
def month_heatmap(s: Staged) -> DataFrame:
    return _heatmap(s)


@query
def month_heatmap_wide(s: Staged) -> DataFrame:
    return cadence.heatmap_wide(_heatmap(s))


@query
def cadence_text(s: Staged) -> DataFrame:
    return cadence.cadence_text(_heatmap(s))


@query
def commit_bars(s: Staged) -> DataFrame:
    return cadence.commit_bars(_reported(s, commits.author_metrics(s.commits)))


@query
def team_totals(s: Staged) -> DataFrame:
    return cadence.team_totals(_reported(s, commits.author_metrics(s.commits)), _heatmap(s))


@query
def staleness(s: Staged) -> DataFrame:
    return cadence.staleness(_reported(s, commits.author_metrics(s.commits)), commits.date_bounds(s.commits))


# --- roster -------------------------------------------------------------------


@query
def dedupe_roster(s: Staged) -> DataFrame:
    return authors.dedupe_roster(s.roster)


@query
def missing_authors(s: Staged) -> DataFrame:
    return authors.missing_authors(commits.discover_authors(s.commits), authors.dedupe_roster(s.roster))


@query
def missing_top10(s: Staged) -> DataFrame:
    return authors.missing_summary(
        authors.missing_authors(commits.discover_authors(s.commits), authors.dedupe_roster(s.roster)))


@query
def author_contains(s: Staged) -> DataFrame:
    return authors.match_author_contains(s.commits, authors.dedupe_roster(s.roster))


# --- packs and scans ------------------------------------------------------------


@query
def language_counts(s: Staged) -> DataFrame:
    return languages.language_counts(s.files)


@query
def dominant_language(s: Staged) -> DataFrame:
    return languages.dominant_language(s.files)


@query
def merged_rules(s: Staged) -> DataFrame:
    return languages.merged_rules(s.files, SMELL_RULES, SECURITY_RULES).select(
        "repo_id", "family", "rule_id", "vector", "severity", "review", "weight", "block",
        F.array_join("packs", ",").alias("packs"))


def _smell_readable(s: Staged) -> DataFrame:
    return scan.readable_files(scan.listed_files(s.files, SMELL, exclude=EXCLUDE))


@query
def smell_line_hits(s: Staged) -> DataFrame:
    rules = [r for r in SMELL_RULES if not r.block]
    return scan.scan_rules(_smell_readable(s), rules).select("repo_id", "path", "rule_id", "line_no", "n")


@query
def smell_block_hits(s: Staged) -> DataFrame:
    rules = [r for r in SMELL_RULES if r.block]
    return scan.scan_rules(_smell_readable(s), rules).select("repo_id", "path", "rule_id", "line_no", "n")


@query
def security_line_hits(s: Staged) -> DataFrame:
    return findings.security_line_hits(s.files, exclude=EXCLUDE).select(
        "repo_id", "path", "rule_id", "line_no", "snippet", "severity", "vector")


@query
def large_files(s: Staged) -> DataFrame:
    return scan.large_files(scan.file_facts(_smell_readable(s)))


@query
def scan_stats(s: Staged) -> DataFrame:
    return scan.scan_stats(scan.listed_files(s.files, SMELL, exclude=EXCLUDE))


@query
def file_majority_owner(s: Staged) -> DataFrame:
    return attribution.majority_owner(attribution.blame_by_file(s.blame_lines))


@query
def attributed_hits(s: Staged) -> DataFrame:
    hits = scan.scan_rules(_smell_readable(s), SMELL_RULES).drop("line", "previous")
    return attribution.attribute_hits(hits, s.blame_lines)


@query
def lines_owned(s: Staged) -> DataFrame:
    return attribution.lines_owned(attribution.blame_by_file(s.blame_lines), _smell_readable(s))


def _smells(s: Staged) -> reports.SmellScan:
    return reports.smell_scan(s.files, s.blame_lines, exclude=EXCLUDE)


@query
def smell_counts(s: Staged) -> DataFrame:
    return _smells(s).counts


@query
def code_grade(s: Staged) -> DataFrame:
    return _smells(s).grades


def _matrix(s: Staged) -> DataFrame:
    return reports.matrix_report(s.commits, s.roster, _smells(s))


@query
def issue_matrix(s: Staged) -> DataFrame:
    return _matrix(s).select("repo_id", "email", "short", "rule_id", "label", "n")


@query
def issue_matrix_heat(s: Staged) -> DataFrame:
    return _matrix(s).select("repo_id", "email", "rule_id", cell_intensity(F.col("n")).alias("intensity"))


@query
def issue_matrix_by_rule(s: Staged) -> DataFrame:
    return scoring.matrix_by_rule(_matrix(s))


@query
def issue_matrix_by_author(s: Staged) -> DataFrame:
    """The matrix as reports show it: a row for each rule, ten people a sheet, as many sheets as show everybody."""
    return reports.matrix_sheets(s.commits, s.roster, _smells(s), _folder(s, "sheets")).drop("position")


@query
def issue_matrix_override(s: Staged) -> DataFrame:
    """One repository shows a matrix written by hand."""
    by_hand = s.roster.filter("repo_id = 'r0' AND position < 5").select(
        "repo_id", "position", F.concat(F.lit("Row "), F.col("position").cast("string")).alias("label"), "short",
        F.when(F.col("position") == 0, "—").otherwise(F.col("position").cast("string")).alias("cell"))
    return scoring.matrix_override(_matrix(s), by_hand).drop("position")


@query
def roster_scaffold(s: Staged) -> DataFrame:
    """A roster of everybody who committed, for repositories without one."""
    return roster_from_authors(commits.discover_authors(s.commits)).drop("badge", "highlight")


@query
def final_grades(s: Staged) -> DataFrame:
    return scoring.final_grades(
        authors.dedupe_roster(s.roster), commits.author_metrics(s.commits), _smells(s).grades)


@query
def author_cards(s: Staged) -> DataFrame:
    cards = reports.author_cards(
        authors.dedupe_roster(s.roster), commits.author_metrics(s.commits),
        commits.line_churn(s.commits, s.commit_files), None)
    return authors.active_authors(authors.visible_authors(cards)).select(
        "repo_id", "email", "short_name", "slug", "commits", "added_text", "deleted_text", "conv_pct", "tickets",
        "git_grade", "git_class")


@query
def author_report(s: Staged) -> DataFrame:
    return reports.author_report(s.commits, s.commit_files, s.roster, s.files, s.blame_lines, exclude=EXCLUDE)


@query
def author_report_stored(s: Staged) -> DataFrame:
    """The same report from a single pass over the texts."""
    return reports.author_report(
        s.commits, s.commit_files, s.roster, s.files, s.blame_lines, exclude=EXCLUDE, store=_folder(s, "smell-scan"))


# --- findings ----------------------------------------------------------------------


def _findings(s: Staged) -> DataFrame:
    return findings.security_findings(
        s.files, s.blame_lines, gitleaks=feeds.normalise_gitleaks(s.gitleaks_raw),
        semgrep=feeds.normalise_semgrep(s.semgrep_raw), exclude=EXCLUDE)


@query
def security_findings(s: Staged) -> DataFrame:
    return _findings(s).drop("rule_position")


@query
def security_findings_stored(s: Staged) -> DataFrame:
    """The same findings by way of stored hits."""
    return findings.security_findings(
        s.files, s.blame_lines, gitleaks=feeds.normalise_gitleaks(s.gitleaks_raw),
        semgrep=feeds.normalise_semgrep(s.semgrep_raw), exclude=EXCLUDE, store=_folder(s, "security-hits"),
    ).drop("rule_position")


@query
def client_key_downgrade(s: Staged) -> DataFrame:
    return _findings(s).filter(F.col("vector") == findings.SECRETS).groupBy(
        "repo_id", "rule_id", "severity", "review").agg(F.count(F.lit(1)).alias("n"))


@query
def secrets_merged(s: Staged) -> DataFrame:
    built_in = findings.built_in_findings(findings.security_line_hits(s.files, exclude=EXCLUDE), s.blame_lines)
    merged = findings.merge_secret_feed(built_in, feeds.normalise_gitleaks(s.gitleaks_raw))
    return merged.select("repo_id", "vector", "rule_id", "path", "line_no", "source", "author_name")


@query
def dedupe_feed(s: Staged) -> DataFrame:
    return feeds.normalise_gitleaks(s.gitleaks_raw).select("repo_id", "rule_id", "path", "line_no", "snippet", "author_name")


@query
def severity_counts(s: Staged) -> DataFrame:
    return ranking.severity_counts(_findings(s))


def _repos(s: Staged) -> DataFrame:
    return s.files.select("repo_id").distinct()


@query
def vector_counts(s: Staged) -> DataFrame:
    return ranking.vector_counts(_findings(s), _repos(s))


@query
def engine_counts(s: Staged) -> DataFrame:
    return ranking.engine_counts(_findings(s), _repos(s), ["built-in", "gitleaks", "semgrep"])


@query
def page_findings(s: Staged) -> DataFrame:
    found = stored_findings(_findings(s), _folder(s, "findings-table"))
    return ranking.page_findings(found).select(
        "repo_id", "vector", "rule_id", "source", "place", "path", "line_no", "n_group", "n_more")


@query
def rule_coverage(s: Staged) -> DataFrame:
    """Hits of every rule of the catalogue."""
    smells = scan.scan_rules(_smell_readable(s), SMELL_RULES).select(F.lit(SMELL).alias("family"), "rule_id", "n")
    large = scan.large_files(scan.file_facts(_smell_readable(s))).select(
        F.lit(SMELL).alias("family"), F.lit(LARGE_RULE_ID).alias("rule_id"), F.lit(1).alias("n"))
    security = findings.security_line_hits(s.files, exclude=EXCLUDE).select(
        F.lit(SECURITY).alias("family"), "rule_id", F.lit(1).alias("n"))
    return smells.unionByName(large).unionByName(security).groupBy("family", "rule_id").agg(F.sum("n").alias("n"))


@query
def custom_rules(s: Staged) -> DataFrame:
    """Rules and file globs of a user's own."""
    own = [Rule("licence", SMELL, ("mine",), r"\bLicensed under\b", label="Licence lines", weight=3),
           Rule("pass", SMELL, ("mine",), r"^pass$", label="Empty lines", weight=2)]
    return reports.smell_scan(s.files, s.blame_lines, rules=own, globs=["*.py", "*.env"], exclude=EXCLUDE).counts


@query
def owner_tally(s: Staged) -> DataFrame:
    return ranking.owner_tally(_findings(s)).drop("first")


@query
def owner_lines(s: Staged) -> DataFrame:
    return ranking.owner_lines(ranking.owner_tally(_findings(s)))


@query
def worst_severity(s: Staged) -> DataFrame:
    return ranking.worst_severity(_findings(s))


@query
def top_findings(s: Staged) -> DataFrame:
    # The list and its group sizes both read the findings, so they are stored first.
    found = stored_findings(_findings(s), _folder(s, "findings-table"))
    return ranking.top_findings(found).select(
        "repo_id", "vector", "rule_id", "place", "path", "line_no", "severity", "n_group", "n_more")


@query
def findings_ranked(s: Staged) -> DataFrame:
    return ranking.findings_ranked(_findings(s)).select(
        "repo_id", "vector", "vector_rank", "severity", "severity_rank", "rule_id", "path", "line_no", "source")


# --- settings of each repository ----------------------------------------------------


@query
def repo_settings(s: Staged) -> DataFrame:
    def text(name: str) -> Column:
        return F.array_join(F.array_sort(name), "|").alias(name)

    return s.settings.select("repo_id", "since", text("exclude"), text("disabled"), "language")


def _stored_by_month(s: Staged) -> DataFrame:
    """The commits as a table stored by month."""
    path = _folder(s, "commits-by-month")
    rows = s.commits.withColumn("commit_month", F.date_format("commit_ts", "yyyy-MM"))
    rows.write.partitionBy("commit_month").parquet(path)
    return s.spark.read.schema(rows.schema).parquet(path)


@query
def period_by_repo(s: Staged) -> DataFrame:
    return commits.author_metrics(in_own_period(_stored_by_month(s), s.settings))


@query
def settings_churn(s: Staged) -> DataFrame:
    return commits.churn_by_repo(in_own_period(s.commits, s.settings), s.commit_files, s.settings)


def _own_scan(s: Staged) -> reports.SmellScan:
    return reports.smell_scan(s.files, s.blame_lines, settings=s.settings, store=_folder(s, "own-scan"))


@query
def settings_smell_counts(s: Staged) -> DataFrame:
    return _own_scan(s).counts


@query
def settings_lines_owned(s: Staged) -> DataFrame:
    return _own_scan(s).owned


@query
def settings_security_hits(s: Staged) -> DataFrame:
    return findings.security_line_hits(s.files, settings=s.settings).select("repo_id", "path", "rule_id", "line_no", "severity")


@query
def settings_findings(s: Staged) -> DataFrame:
    """Findings of all engines by the settings of each repository."""
    found = findings.security_findings(
        s.files, s.blame_lines, gitleaks=feeds.normalise_gitleaks(s.gitleaks_raw), semgrep=feeds.normalise_semgrep(s.semgrep_raw),
        settings=s.settings)
    return found.select("repo_id", "path", "rule_id", "line_no", "severity", "source")


# --- own block rules, run-length blame ------------------------------------------------

# Patterns that would run long or deep in a backtracking engine.
OWN_BLOCKS = [
    Rule("runs", SMELL, ("mine",), r"(a|e|n|r|t|h| )*\.", block=True, label="Long runs"),
    Rule("braces", SMELL, ("mine",), r"\{([^{}]|\s)*\}", guards=("{",), block=True, label="Blocks in braces"),
    Rule("quoted", SMELL, ("mine",), r"([\"'])(?:(?!\1)[^\n])*\1\s*[;)]", block=True, path_include=r"\.(ts|java)$", label="Quoted ends"),
    Rule("broken", SMELL, ("mine",), r"(unclosed", block=True, path_include=r"\.dart$", label="Not a pattern"),
]


@query
def custom_block_rules(s: Staged) -> DataFrame:
    """Block rules of a user's own: one with a back reference, and one that is no pattern at all."""
    return scan_blocks(_smell_readable(s), OWN_BLOCKS).select(
        "repo_id", "path", "rule_id", "line_no", "n", F.col("error").isNotNull().alias("failed"))


def _runs(s: Staged) -> DataFrame:
    path = _folder(s, "blame-runs")
    blame_runs.runs_of_lines(s.blame_stretches).write.parquet(path)
    return s.spark.read.parquet(path)


@query
def blame_run_lengths(s: Staged) -> DataFrame:
    return blame_runs.runs_of_lines(s.blame_stretches)


@query
def attributed_hits_runs(s: Staged) -> DataFrame:
    hits = scan.scan_rules(_smell_readable(s), SMELL_RULES).drop("line", "previous")
    return blame_runs.attribute_hits(hits, _runs(s))


@query
def lines_owned_runs(s: Staged) -> DataFrame:
    return attribution.lines_owned(blame_runs.blame_by_file(_runs(s)), _smell_readable(s))


@query
def file_majority_owner_runs(s: Staged) -> DataFrame:
    return attribution.majority_owner(blame_runs.blame_by_file(_runs(s)))


# --- delta ------------------------------------------------------------------------


@query
def delta_vs_snapshot(s: Staged) -> DataFrame:
    return delta.delta_vs_snapshot(commits.author_metrics(s.commits), latest_snapshot(s.snapshots))


@query
def snapshot_rows(s: Staged) -> DataFrame:
    return deltas.build_snapshot(s.commits, s.commit_files, s.snapshots, exclude=EXCLUDE)


@query
def delta_report(s: Staged) -> DataFrame:
    return deltas.delta_report(s.commits, s.roster, s.snapshots)


# --- streaming -------------------------------------------------------------------


def _folder(s: Staged, name: str) -> str:
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex}"


@query
def stream_author_metrics(s: Staged) -> DataFrame:
    base = _folder(s, "author-metrics")
    s.commits.write.parquet(f"{base}/in")
    streams.stream_author_metrics(
        streams.read_commit_stream(s.spark, f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    return streams.current_metrics(s.spark, f"{base}/out")


@query
def stream_findings(s: Staged) -> DataFrame:
    base = _folder(s, "findings")
    s.files.write.parquet(f"{base}/in")
    streams.stream_findings(
        streams.read_file_stream(s.spark, f"{base}/in"), f"{base}/out", f"{base}/state", packs=list(PACKS),
        exclude=EXCLUDE, blame_lines=s.blame_lines).awaitTermination()
    return s.spark.read.parquet(f"{base}/out").select(
        "repo_id", "path", "rule_id", "line_no", "snippet", "severity", "vector", "author_name", "author_email")


@query
def stream_snapshots(s: Staged) -> DataFrame:
    base = _folder(s, "snapshots")
    s.commits.write.parquet(f"{base}/in")
    streams.stream_snapshots(
        streams.read_commit_stream(s.spark, f"{base}/in"), f"{base}/totals", f"{base}/out", f"{base}/state").awaitTermination()
    return latest_snapshot(read_snapshots(s.spark, f"{base}/out")).select(
        "repo_id", "email", "commits", "last_active", "compiled_date")
