"""Security report: findings once, every table of the report from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from repolens.operators.findings import BUILT_IN
from repolens.operators.ranking import (
    engine_counts,
    findings_ranked,
    owner_lines,
    owner_tally,
    page_findings,
    severity_counts,
    top_findings,
    vector_counts,
    worst_severity,
)
from repolens.sources.tables import write_findings, write_report_table


@dataclass(frozen=True)
class SecurityReport:
    ranked: DataFrame
    top: DataFrame
    page_top: DataFrame
    severities: DataFrame
    vectors: DataFrame
    engines: DataFrame
    groups: DataFrame
    owners: DataFrame
    owner_lines: DataFrame

    def write(self, folder: str) -> None:
        for name, table in vars(self).items():
            write_report_table(table, folder, name)


def security_report(findings: DataFrame, files: DataFrame, engines: tuple[str, ...] = (BUILT_IN,)) -> SecurityReport:
    """Report tables.  Pass a stored findings table (``stored_findings``), or each table scans again."""
    repos = files.select("repo_id").distinct()
    tally = owner_tally(findings)
    return SecurityReport(
        ranked=findings_ranked(findings), top=top_findings(findings), page_top=page_findings(findings), severities=severity_counts(findings),
        vectors=vector_counts(findings, repos), engines=engine_counts(findings, repos, engines),
        groups=worst_severity(findings), owners=tally, owner_lines=owner_lines(tally))


def stored_findings(findings: DataFrame, path: str) -> DataFrame:
    """Write findings and read them back: a cut in the lineage that survives lost executors."""
    write_findings(findings, path)
    return findings.sparkSession.read.schema(findings.schema).parquet(path)
