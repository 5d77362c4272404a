"""Languages present in a repository and the rules that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions.paths import language_of
from repolens.rules import PACKS, Rule, rule_catalogue

GENERIC = "generic"


def explicit_packs(language: str | None) -> list[str] | None:
    """The one pack of a named language; None, meaning detection, for no or an unknown name."""
    return [language] if language in PACKS else None


def language_counts(files: DataFrame) -> DataFrame:
    """Tracked files per repository and known language (reads paths only)."""
    return (
        files.select("repo_id", language_of(F.col("path")).alias("language"))
        .filter(F.col("language").isNotNull())
        .groupBy("repo_id", "language")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def dominant_language(files: DataFrame) -> DataFrame:
    """Language with the most files per repository; ties follow pack order, none is generic."""
    place = F.lit(len(PACKS))
    for pack in PACKS.values():
        place = F.when(F.col("language") == pack.pack_id, F.lit(pack.position)).otherwise(place)
    repos = files.select("repo_id").distinct()
    top = language_counts(files).groupBy("repo_id").agg(
        F.min_by("language", F.struct(-F.col("files"), place)).alias("language"))
    return repos.join(top, "repo_id", "left").select(
        "repo_id", F.coalesce("language", F.lit(GENERIC)).alias("language"))


def present_packs(files: DataFrame) -> DataFrame:
    """One row per repository with the packs that apply: its languages and the generic one."""
    packs = F.collect_set(language_of(F.col("path")))
    return files.groupBy("repo_id").agg(
        F.array_union(packs, F.array(F.lit(GENERIC))).alias("packs"))


def merged_rules(files: DataFrame, smells: Sequence[Rule], security: Sequence[Rule]) -> DataFrame:
    """Rules that apply to each repository: one row per rule, first pack's definition, all its packs."""
    catalogue = rule_catalogue(files.sparkSession, smells, security)
    per_pack = present_packs(files).select("repo_id", F.explode("packs").alias("pack"))
    definition = F.struct("vector", "severity", "label", "pattern", "block", "review", "weight")
    # The catalogue is a driver-side list of a few dozen rules, never data.
    return (
        per_pack.join(F.broadcast(catalogue), "pack")
        .groupBy("repo_id", "family", "rule_id")
        .agg(
            F.min_by(definition, F.col("pack_position")).alias("rule"),
            F.array_sort(F.collect_set("pack")).alias("packs"),
            F.min("position").alias("position"),
        )
        .select("repo_id", "family", "rule_id", "position", "rule.*", "packs")
    )
