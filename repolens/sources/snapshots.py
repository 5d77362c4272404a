"""Snapshots of author totals, partitioned by compile date and build.

A build is one run over some repositories.  Writing it again replaces only its own
partitions, so a retried job changes nothing and builds of other repositories that
share the date are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.operators.skew import join_per_repo
from repolens.sources.tables import SNAPSHOTS


def write_snapshot(rows: DataFrame, path: str, build: str = "all") -> None:
    rows.withColumn("build", F.lit(build)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("compiled_date", "build").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOTS + ", build STRING").parquet(path)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Rows of the last build of each repository."""
    last = snapshots.groupBy("repo_id").agg(F.max(F.struct("compiled_date", "build")).alias("last"))
    rows = join_per_repo(snapshots, last, ["email"])
    return rows.filter(F.struct("compiled_date", "build") == F.col("last")).drop("last")
