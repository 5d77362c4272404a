from pyspark.sql import functions as F

from repolens.plans.stages import Stages, fingerprint


def table(spark, path, n):
    spark.range(n).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def test_a_stage_is_computed_once_and_again_when_its_inputs_change(spark, tmp_path):
    given, folder = str(tmp_path / "in"), str(tmp_path / "out")
    made = lambda: spark.read.parquet(given).groupBy((F.col("id") % 3).alias("k")).count()
    table(spark, given, 10)
    first = Stages(spark, folder)
    assert first.table("a", made()).count() == 3 and first.table("a", made()).count() == 3
    assert (first.computed, first.reused) == (["a"], ["a"])
    again = Stages(spark, folder)
    assert sum(r["count"] for r in again.table("a", made()).collect()) == 10 and again.computed == []
    assert again.table("a", made().filter("k > 0")).count() == 2 and again.computed == ["a"]
    table(spark, given, 5)
    later = Stages(spark, folder)
    assert sum(r["count"] for r in later.table("a", made()).collect()) == 15 and later.computed == ["a"]


def test_rows_of_the_driver_have_no_fingerprint(spark, tmp_path):
    local = spark.createDataFrame([(1,)], "x INT")
    assert fingerprint(local) is None
    stages = Stages(spark, str(tmp_path))
    stages.table("a", local), stages.table("a", local)
    assert stages.computed == ["a", "a"] and stages.reused == []


def test_a_stage_that_was_not_finished_is_not_taken(spark, tmp_path):
    given = table(spark, str(tmp_path / "in"), 4)
    stages = Stages(spark, str(tmp_path))
    before = stages.table("a", given)
    spark.createDataFrame([(None,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{stages.folder}/a.fingerprint")
    assert stages.table("a", given).count() == before.count() == 4 and stages.computed == ["a", "a"]
