from pyspark.sql import functions as F

from repolens.operators.skew import join_per_repo


def test_salted_join_equals_the_plain_one(spark):
    # one repository holds nearly all rows
    rows = spark.range(3000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("r"), F.col("id") % 7)).otherwise(F.lit("hot")).alias("repo_id"),
        F.col("id").cast("string").alias("path"))
    repos = rows.select("repo_id").distinct().filter("repo_id <> 'r3'").withColumn("fact", F.length("repo_id"))
    for how in ("inner", "left"):
        plain = rows.join(repos, "repo_id", how)
        salted = join_per_repo(rows, repos, ["path"], how).select(plain.columns)
        assert salted.exceptAll(plain).count() == 0 and salted.count() == plain.count()


def test_salt_spreads_the_hot_repository(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(2000).select(F.lit("hot").alias("repo_id"), F.col("id").cast("string").alias("path"))
        repos = spark.range(1).select(F.lit("hot").alias("repo_id"), F.lit(1).alias("fact"))
        joined = join_per_repo(rows, repos, ["path"])
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in sizes) == 2000 and len(sizes) == 4
