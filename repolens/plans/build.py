"""One call for a whole build: every report table, written once, and the next snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame

from repolens.functions.suppression import DEFAULT_MARKERS, Markers
from repolens.operators import cadence
from repolens.operators.authors import dedupe_roster, missing_authors, missing_summary, reported
from repolens.operators.commits import author_metrics, date_bounds, discover_authors, line_churn, monthly_cadence
from repolens.operators.findings import BUILT_IN, GITLEAKS, SEMGREP, security_findings
from repolens.operators.languages import explicit_packs, language_counts
from repolens.operators.scan import listed_files, scan_stats
from repolens.operators.scoring import code_grades, issue_matrix, matrix_override
from repolens.operators.settings import drop_excluded, in_own_period
from repolens.plans.author_report import author_cards, people_of_matrix, smell_scan
from repolens.plans.delta_report import delta_report, snapshot_of
from repolens.plans.security_report import security_report, stored_findings
from repolens.plans.stages import Stages
from repolens.rules import SECURITY, SECURITY_RULES, SMELL, SMELL_RULES, Rule
from repolens.sources.config import roster_from_authors
from repolens.sources.snapshots import write_snapshot
from repolens.sources.tables import write_report_table


@dataclass(frozen=True)
class Inputs:
    """The tables of a build.  Without a roster everybody who committed is reported."""

    commits: DataFrame
    commit_files: DataFrame
    files: DataFrame
    blame_lines: DataFrame
    roster: DataFrame | None = None
    gitleaks: DataFrame | None = None
    semgrep: DataFrame | None = None
    snapshots: DataFrame | None = None
    matrix_by_hand: DataFrame | None = None
    #: Settings of each repository (``sources.config.merged_settings``), beside the options that hold for all.
    settings: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    since: date | str | None = None
    exclude: Sequence[str] = ()
    disabled: Sequence[str] = ()
    language: str | None = None
    markers: Markers = DEFAULT_MARKERS
    smells: Sequence[Rule] = field(default=SMELL_RULES)
    security: Sequence[Rule] = field(default=SECURITY_RULES)
    scan_smells: bool = True
    scan_security: bool = True


def build(inputs: Inputs, folder: str, *, options: Options = Options(), snapshot_path: str | None = None,
          build_id: str = "all") -> list[str]:
    """Write the report tables below ``folder``; returns their names.

    What several tables need is a stage (:class:`.Stages`): commits, texts and blame are each read by one stage a kind, and a
    build over unchanged inputs starts from the stages of the last one.
    """
    o, packs = options, explicit_packs(options.language)
    stages = Stages(inputs.commits.sparkSession, folder)
    discovered = stages.table("discovered", discover_authors(inputs.commits))
    roster = inputs.roster if inputs.roster is not None else roster_from_authors(discovered)
    people = dedupe_roster(roster)
    recent, changes = inputs.commits, inputs.commit_files
    if inputs.settings is not None:
        recent, changes = in_own_period(recent, inputs.settings), drop_excluded(changes, inputs.settings)
    metrics = stages.table("metrics", author_metrics(recent, o.since))
    bounds = stages.table("bounds", date_bounds(inputs.commits))
    months = stages.table("months", monthly_cadence(recent, o.since))
    churn = stages.table("churn", line_churn(recent, changes, exclude=o.exclude, since=o.since))
    shown = reported(metrics, people)
    heatmap = stages.table("heatmap", cadence.month_heatmap(reported(months, people), bounds))
    tables = {
        "languages": language_counts(inputs.files), "bounds": bounds, "months": months, "heatmap": heatmap,
        "cadence": cadence.cadence_text(heatmap), "bars": cadence.commit_bars(shown),
        "totals": cadence.team_totals(shown, heatmap), "staleness": cadence.staleness(shown, bounds),
        "missing_authors": missing_summary(missing_authors(discovered, people)),
    }
    grades = None
    if o.scan_smells:
        scan = smell_scan(
            inputs.files, inputs.blame_lines, rules=o.smells, packs=packs, exclude=o.exclude, disabled=o.disabled,
            markers=o.markers, store=f"{folder}/scan/smells", settings=inputs.settings)
        counts = stages.table("smell_counts", scan.counts)
        grades = stages.table("code_grades", code_grades(counts, scan.owned, o.smells))
        cards = people_of_matrix(metrics, roster)
        matrix = issue_matrix(counts, cards, o.smells, disabled=o.disabled)
        tables["smell_counts"] = counts
        tables["issue_matrix"] = matrix_override(matrix, inputs.matrix_by_hand)
        tables["scan_stats"] = scan_stats(listed_files(inputs.files, SMELL, packs=packs, exclude=o.exclude))
    tables["authors"] = author_cards(people, metrics, churn, grades)
    tables["delta"] = delta_report(inputs.commits, roster, inputs.snapshots, grades=grades, since=o.since, metrics=metrics, bounds=bounds)
    for name, table in tables.items():
        write_report_table(table, folder, name)
    if o.scan_security:
        found = stored_findings(
            security_findings(
                inputs.files, inputs.blame_lines, gitleaks=inputs.gitleaks, semgrep=inputs.semgrep, rules=o.security,
                packs=packs, exclude=o.exclude, disabled=o.disabled, markers=o.markers,
                store=f"{folder}/scan/security", settings=inputs.settings),
            f"{folder}/findings")
        engines = [BUILT_IN]
        engines += [GITLEAKS] if inputs.gitleaks is not None else []
        engines += [SEMGREP] if inputs.semgrep is not None else []
        listed = listed_files(inputs.files, SECURITY, packs=packs, exclude=o.exclude)
        report = security_report(found, listed, tuple(engines))
        report.write(f"{folder}/security")
        tables |= {f"security/{name}": table for name, table in vars(report).items()}
    if snapshot_path is not None:
        write_snapshot(
            snapshot_of(metrics, churn, bounds, inputs.snapshots, since=o.since, roster=roster),
            snapshot_path, build=build_id)
    return sorted(tables)
