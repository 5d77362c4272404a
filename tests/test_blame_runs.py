import random

from repolens.operators import attribution, blame_runs

LINES = "repo_id STRING, path STRING, line_no INT, author_name STRING, author_email STRING"
HITS = "repo_id STRING, path STRING, line_no INT, rule_id STRING, n INT"


def blame(spark, seed=1, files=12, length=300):
    rnd, rows = random.Random(seed), []
    for f in range(files):
        line = 1
        while line <= length:
            who, stretch = rnd.choice(["ann", "Ben", "", None]), rnd.randint(1, 40)
            if rnd.random() < 0.9:  # else lines without blame
                rows += [("r", f"f{f}", k, who, f"{who}@EX.com" if who else who) for k in range(line, min(line + stretch, length + 1))]
            line += stretch
    return spark.createDataFrame(rows, LINES)


def table(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_ownership_and_hits_are_the_same_on_both_layouts(spark):
    lines = blame(spark)
    runs = blame_runs.runs_of_lines(lines)
    assert runs.count() * 5 < lines.count()
    by_line, by_run = attribution.blame_by_file(lines), blame_runs.blame_by_file(runs)
    columns = "repo_id", "path", "email", "n", "first_line"
    assert table(by_line, *columns) == table(by_run, *columns)
    assert table(attribution.majority_owner(by_line), "repo_id", "path", "email") == table(attribution.majority_owner(by_run), "repo_id", "path", "email")
    rnd = random.Random(3)
    hits = spark.createDataFrame([("r", f"f{rnd.randint(0, 14)}", rnd.randint(1, 310), f"rule{k % 3}", k) for k in range(400)], HITS)
    columns = *hits.columns, "author_name", "author_email"
    assert table(attribution.attribute_hits(hits, lines), *columns) == table(blame_runs.attribute_hits(hits, runs), *columns)


def test_runs_end_where_the_author_or_the_numbers_change(spark):
    rows = [("r", "a", n, who, None) for n, who in ((1, "x"), (2, "x"), (4, "x"), (5, "y"), (6, None), (7, None), (8, "y"))]
    got = [tuple(r)[2:5] for r in blame_runs.runs_of_lines(spark.createDataFrame(rows, LINES)).orderBy("first_line").collect()]
    assert got == [(1, 2, "x"), (4, 4, "x"), (5, 5, "y"), (6, 7, None), (8, 8, "y")]


def test_no_blame_and_no_hits(spark):
    none, hits = spark.createDataFrame([], LINES), spark.createDataFrame([("r", "a", 3, "x", 1)], HITS)
    runs = blame_runs.runs_of_lines(none)
    assert runs.count() == 0 and blame_runs.blame_by_file(runs).count() == 0
    (row,) = blame_runs.attribute_hits(hits, runs).collect()
    assert (row["author_name"], row["author_email"]) == ("unknown", None)
    assert blame_runs.attribute_hits(hits.limit(0), runs).count() == 0


def test_texts_and_lines_are_not_made_for_ownership(spark):
    plan = blame_runs.blame_by_file(blame_runs.runs_of_lines(blame(spark, files=1)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
