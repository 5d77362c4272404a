"""Counts, tallies and ranked lists of findings.

Counts are plain partial aggregates.  The only windows rank rows up to a small limit,
which Spark applies on the map side before it shuffles the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.functions.report import severity_rank, vector_rank
from repolens.operators.findings import BUILT_IN, GITLEAKS, SEMGREP
from repolens.rules import SEVERITIES, VECTORS

GROUP = ("repo_id", "vector", "rule_id")
TOP_IN_TEXT_REPORT = 20
TOP_IN_PAGE_REPORT = 15


def source_rank(source: Column) -> Column:
    return F.when(source == BUILT_IN, 0).when(source == GITLEAKS, 1).when(source == SEMGREP, 2).otherwise(3)


def _encounter() -> Column:
    """Position of a finding inside its vector: severity, engine, then file order."""
    return F.struct(
        severity_rank(F.col("severity")).alias("severity_rank"), source_rank(F.col("source")).alias("source_rank"),
        F.col("path"), F.col("rule_position"), F.col("line_no"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per repository and severity (absent severities count 0)."""
    severity = F.col("severity")
    return findings.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(severity == name).alias(name.lower()) for name in SEVERITIES))


def vector_counts(findings: DataFrame, repos: DataFrame, vectors: Sequence[str] = VECTORS) -> DataFrame:
    """Findings per repository and vector; the known vectors show even when empty."""
    counted = findings.groupBy("repo_id", "vector").agg(
        F.count(F.lit(1)).alias("n"), F.min(severity_rank(F.col("severity"))).alias("worst_rank"))
    scaffold = repos.select("repo_id", F.explode(F.array(*map(F.lit, vectors))).alias("vector"))
    return (
        scaffold.join(counted, ["repo_id", "vector"], "full")
        .select("repo_id", "vector", F.coalesce("n", F.lit(0)).alias("n"),
                _severity_name(F.col("worst_rank")).alias("worst_severity"))
    )


def _severity_name(rank: Column) -> Column:
    return F.when(rank < len(SEVERITIES), F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1))


def engine_counts(findings: DataFrame, repos: DataFrame, engines: Sequence[str]) -> DataFrame:
    """Findings per repository, engine and vector; an engine that ran shows even at 0."""
    counted = findings.groupBy("repo_id", "source", "vector").agg(F.count(F.lit(1)).alias("n"))
    scaffold = repos.select("repo_id", F.explode(F.array(*map(F.lit, engines))).alias("source"))
    return scaffold.join(counted, ["repo_id", "source"], "left").select(
        "repo_id", "source", "vector", F.coalesce("n", F.lit(0)).alias("n"))


def worst_severity(findings: DataFrame) -> DataFrame:
    """Most severe finding and size of every rule group."""
    return findings.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        _severity_name(F.min(severity_rank(F.col("severity")))).alias("worst_severity"))


def owner_tally(findings: DataFrame) -> DataFrame:
    """Findings per rule group and owner, with the owner's ``name (n)`` text (long form)."""
    return (
        findings.groupBy(*GROUP, "author_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min(_encounter()).alias("first"))
        .withColumn("text", F.concat("author_name", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    )


def owner_lines(tally: DataFrame) -> DataFrame:
    """One line of owners per rule group, most findings first, ties in order of appearance.

    A group holds one entry per distinct owner, never one per finding.
    """
    entry = F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("text"))
    return tally.groupBy(*GROUP).agg(
        F.array_join(F.sort_array(F.collect_list(entry))["text"], ", ").alias("owners"))


def top_findings(
    findings: DataFrame, limit: int = TOP_IN_TEXT_REPORT, group: Sequence[str] = GROUP) -> DataFrame:
    """First findings of every rule group and how many more there are."""
    order = Window.partitionBy(*group).orderBy(_encounter())
    first = findings.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    sizes = findings.groupBy(*group).agg(F.count(F.lit(1)).alias("n_group"))
    return first.join(sizes, list(group)).withColumn(
        "n_more", F.greatest(F.col("n_group") - limit, F.lit(0)))


def page_findings(findings: DataFrame, limit: int = TOP_IN_PAGE_REPORT) -> DataFrame:
    """The shorter lists of the page report: per rule and engine."""
    return top_findings(findings, limit, (*GROUP, "source"))


def findings_ranked(findings: DataFrame) -> DataFrame:
    """Report order: vector, severity, then order of appearance (a range-partitioned sort)."""
    return (
        findings.withColumn("vector_rank", vector_rank(F.col("vector")))
        .withColumn("severity_rank", severity_rank(F.col("severity")))
        .orderBy("repo_id", "vector_rank", "vector", "severity_rank", source_rank(F.col("source")), "path",
                 "rule_position", "line_no")
    )
