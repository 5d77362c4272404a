"""Growing feeds of commits and files.

Stateful aggregates hold one row per author and month; a stream never collects raw
commits.  Every batch is written under its own batch id, so a batch that is retried
after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from repolens.functions.commits import (
    activity_day,
    activity_key,
    email_key,
    has_ticket,
    is_conventional,
    month_of,
    percentage,
)
from repolens.functions.suppression import DEFAULT_MARKERS, Markers
from repolens.operators.attribution import attribute_hits
from repolens.operators.findings import security_line_hits
from repolens.rules import SECURITY_RULES, Rule
from repolens.sources.snapshots import write_snapshot
from repolens.sources.tables import COMMITS, FILES

KEY = ("repo_id", "email", "month")


def read_commit_stream(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(COMMITS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_file_stream(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def distinct_commits(stream: DataFrame, *, within: str | None = None) -> DataFrame:
    """Drop commits seen before: one commit is reachable from many branches.

    Old commits may arrive at any time, so the default keeps every key.  ``within``
    bounds that state for feeds whose copies arrive close together.
    """
    if within is None:
        return stream.dropDuplicates(["repo_id", "sha"])
    return stream.withWatermark("commit_ts", within).dropDuplicatesWithinWatermark(["repo_id", "sha"])


def monthly_metrics(stream: DataFrame) -> DataFrame:
    """Running totals per author and month (update mode)."""
    subject = F.col("subject")
    return stream.groupBy(
        "repo_id", email_key(F.col("author_email")).alias("email"), month_of(F.col("author_date")).alias("month")
    ).agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(is_conventional(subject)).alias("conv"),
        F.count_if(has_ticket(subject)).alias("tickets"),
        F.max(activity_key(F.col("commit_ts"), F.col("author_date"))).alias("latest"))


def _merge_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch's totals as a whole new generation, over the one before the last.

    A batch updates the months of its own keys and carries all others over, so the folder holds two generations however long the stream
    runs. A batch that runs again starts from the same generation and writes the same rows; until its write commits, readers see the last one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id:
            before = spark.read.schema(batch.schema).parquet(f"{folder}/generation={(batch_id - 1) % 2}")
            rows = before.join(batch.select(*KEY), list(KEY), "left_anti").select(batch.columns).unionByName(batch)
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/generation={batch_id % 2}")

    return write


def stream_author_metrics(commits: DataFrame, folder: str, checkpoint: str, *, within: str | None = None, **trigger) -> StreamingQuery:
    """Keep author totals up to date; read them with ``current_metrics``. ``within`` bounds the state of :func:`distinct_commits`."""
    return (
        monthly_metrics(distinct_commits(commits, within=within)).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(_merge_batch(folder)).start()
    )


def current_months(spark: SparkSession, folder: str) -> DataFrame:
    """The newest generation of all author months."""
    rows = spark.read.parquet(folder).drop("generation")
    newest = rows.agg(F.max("batch_id")).first()[0]
    return rows.filter(F.col("batch_id") == F.lit(newest)).drop("batch_id")


def current_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Author totals, equal to the batch metrics over all commits seen so far."""
    totals = current_months(spark, folder).groupBy("repo_id", "email").agg(
        F.sum("commits").alias("commits"), F.sum("conv").alias("conv"), F.sum("tickets").alias("tickets"),
        activity_day(F.max("latest")).alias("last_active"))
    return totals.withColumns({
        "conv_pct": percentage(F.col("conv"), F.col("commits")),
        "ticket_pct": percentage(F.col("tickets"), F.col("commits"))})


def stream_findings(
    files: DataFrame, folder: str, checkpoint: str, *, rules: Sequence[Rule] = SECURITY_RULES,
    packs: Sequence[str], exclude: Sequence[str] = (), disabled: Sequence[str] = (),
    markers: Markers = DEFAULT_MARKERS, blame_lines: DataFrame | None = None, **trigger,
) -> StreamingQuery:
    """Scan new files as they arrive (stateless, append).

    A stream does not know all files of a repository, so the packs are named. With ``blame_lines``, a table, each finding has the
    owner of its line as of the batch that finds it: the table is read anew for every batch.
    """
    hits = security_line_hits(files, rules, packs=packs, exclude=exclude, disabled=disabled, markers=markers)
    if blame_lines is not None:
        hits = attribute_hits(hits, blame_lines)
    return (
        hits.drop("client_text").writeStream.outputMode("append").format("parquet").option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_snapshots(
    commits: DataFrame, totals: str, snapshots: str, checkpoint: str, *, within: str | None = None, **trigger,
) -> StreamingQuery:
    """After every batch, store the changed totals and a snapshot of all authors so far.

    Lines are not part of a commit feed; their totals are 0 here.
    """
    save_totals = _merge_batch(totals)

    def write(batch: DataFrame, batch_id: int) -> None:
        save_totals(batch, batch_id)
        spark = batch.sparkSession
        now = current_metrics(spark, totals)
        through = now.groupBy("repo_id").agg(F.max("last_active").alias("compiled_date"))
        rows = now.join(through, "repo_id").select(
            "repo_id", "email", "commits", F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"),
            "last_active", F.lit(None).cast("date").alias("previous_compiled_date"), "compiled_date")
        write_snapshot(rows, snapshots, build=f"batch-{batch_id:012d}")

    return (
        monthly_metrics(distinct_commits(commits, within=within)).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write).start()
    )
