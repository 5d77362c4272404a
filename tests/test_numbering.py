import random

from pyspark.sql import functions as F

from repolens.operators.numbering import numbered
from repolens.operators.scoring import matrix_by_author


def test_numbers_run_through_groups_of_any_size(spark, tmp_path):
    rnd = random.Random(1)
    rows = [("hot" if k % 3 else f"g{k % 17}", rnd.random(), k) for k in range(3000)]
    table = spark.createDataFrame(rows, "g STRING, x DOUBLE, k INT").repartition(7)
    got = {r["k"]: r["n"] for r in numbered(table, "g", ["x", "k"], str(tmp_path / "n")).collect()}
    want, seen = {}, {}
    for g, x, k in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    assert got == want
    assert numbered(table.limit(0), "g", ["x", "k"], str(tmp_path / "none")).count() == 0


def test_every_person_of_the_matrix_is_on_a_sheet(spark, tmp_path):
    people = spark.createDataFrame([("r", f"p{k:02}@ex", f"s{k % 5}") for k in range(23)], "repo_id STRING, email STRING, short STRING")
    matrix = people.select("repo_id", "email", "short", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("rule_id")).select(
        "*", F.lit(1).alias("position"), F.lit("L").alias("label"), F.expr("cast(substr(email, 2, 2) as int)").alias("n"))
    sheets = matrix_by_author(matrix, numbered(people, "repo_id", ["short", "email"], str(tmp_path / "p"), "place_no"), 10).collect()
    assert sorted((r["sheet"], r["rule_id"]) for r in sheets) == [(s, k) for s in range(3) for k in "ab"]
    shown = [r[f"p{p}"] for r in sheets for p in range(10)]
    assert sum(x is None for x in shown) == 2 * 7 and sum(x or 0 for x in shown) == 2 * sum(range(23))
    assert {r["people"] for r in sheets if r["sheet"] == 0} == {", ".join(["s0"] * 5 + ["s1"] * 5)} and sheets[0]["people"]
