"""Files as bytes: what can't be read as text leaves with a reason instead of as garbled text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.sources.git_export import repo_and_path

NOT_TEXT, TOO_LARGE = "not UTF-8", "too large"
#: Larger files are not loaded; a value of a row must stay well below two gigabytes.
MOST_BYTES = 1 << 30


def read_file_bytes(spark: SparkSession, root: str, repo_id: str | None = None, *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``repo_id, path, n_bytes, content, problem`` of the files below ``root``; without ``repo_id`` of many repositories.

    ``content`` is the text of files that are strictly UTF-8 and null for all others, whose ``problem`` says why. Larger files than
    ``most_bytes`` are known by their length alone: a second listing, which reads no byte, brings them in few tasks, since Spark
    deals files to tasks as if each had to be opened. Spark lists no files of length 0.
    """
    repo, path = repo_and_path(spark, root, repo_id)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = listed.filter(F.col("length") <= most_bytes)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = small.select(repo.alias("repo_id"), path.alias("path"), F.col("length").alias("n_bytes"), text.alias("content"))
    read = read.withColumn("problem", F.when(F.col("content").isNull(), F.lit(NOT_TEXT)))
    large = listed.filter(F.col("length") > most_bytes).select(
        repo.alias("repo_id"), path.alias("path"), F.col("length").alias("n_bytes"), F.lit(None).cast("string").alias("content"),
        F.lit(TOO_LARGE).alias("problem")).coalesce(spark.sparkContext.defaultParallelism)
    return read.unionByName(large)


def readable(files: DataFrame) -> DataFrame:
    """The files that a scan can read, in the layout that it takes."""
    return files.filter("problem IS NULL").select("repo_id", "path", "content")
