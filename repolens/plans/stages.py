"""Stored stages of a build: each table is computed once, and again only when what it is made of has changed."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Tables below ``folder/stages``, each with the fingerprint of its plan and of the files it reads.

    A stage whose fingerprint is the stored one is read, not computed: also one of an earlier build, and one that a failed build had finished.
    Each version is a folder of its own, and the fingerprint, which names it, is written last: what reads an earlier version goes on reading it.
    A plan that reads no files (rows from the driver) has no fingerprint and is always computed. File names stand for their
    contents: this holds for tables that Spark writes, whose files are never changed in place.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/stages"
        self.computed: list[str] = []
        self.reused: list[str] = []

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """The stored table of ``df``, written where it is missing or made of something else."""
        mark, wanted = f"{self.folder}/{name}.fingerprint", fingerprint(df)
        known, version = self._known(mark)
        if wanted is not None and known == wanted:
            self.reused.append(name)
        else:
            version = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{version}")
            if wanted is not None:
                self.spark.createDataFrame([(f"{wanted} {version}",)], "value STRING").coalesce(1).write.mode("overwrite").text(mark)
            self.computed.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{version}")

    def _known(self, mark: str) -> tuple[str | None, str | None]:
        try:
            row = self.spark.read.text(mark).first()
        except (AnalysisException, Py4JJavaError):  # there is none yet
            return None, None
        found = row["value"].split(" ") if row and row["value"] else []
        return (found[0], found[1]) if len(found) == 2 else (None, None)


def fingerprint(df: DataFrame) -> str | None:
    """A digest of the plan's meaning and of the names of all files it reads; None where it reads rows of the driver."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(kind in plan.toString() for kind in ("LocalRelation", "LogicalRDD", "ExternalRDD")):
        return None
    files = sorted(df.inputFiles())
    if not files:
        return None
    schema = json.dumps(json.loads(df.schema.json()), sort_keys=True)
    return hashlib.sha256("\n".join([schema, str(df.semanticHash()), *files]).encode()).hexdigest()
