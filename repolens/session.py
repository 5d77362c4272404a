"""Session settings the jobs are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions, splits skewed ones and replaces a sort-merge
# join by a broadcast only after it has measured the side.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # File texts are wide: smaller splits keep a task's rows well inside executor memory.
    "spark.sql.files.maxPartitionBytes": "64m",
    # Plans are built from many small expressions; recording a call site for each costs more
    # than building them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Tables bucketed by file join hits with blame by line without another shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def session(app_name: str = "repolens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder (tests); any other raises, since
    files on one machine's disk are not seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} share")
    return tempfile.mkdtemp(prefix="repolens-")
