import datetime

from pyspark.sql import functions as F

from repolens.functions import commits as c
from repolens.functions import report as r
from repolens.functions.grades import code_grade, smell_density
from repolens.functions.paths import glob_to_regex, is_generated, language_of, path_matches, repo_name
from repolens.functions.sast import sast_severity, sast_vector
from repolens.functions.suppression import Markers, is_sample_credential, is_suppressed


def values(spark, rows, schema, expr):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i INT, {schema}")
    return [x.v for x in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_globs(spark):
    globs = ["third/**", "gen/*", "*.snap", "**/site-map.json"]
    paths = ["third/a/b/C.kt", "gen/out.dart", "web/ui/page.snap", "a/b/c/site-map.json", "web/ui/page.snapshot",
             "./third/x", r"third\y\z", "a_third/x", "web/page.snap/inner.ts", None]
    assert values(spark, [(p,) for p in paths], "p STRING", path_matches(F.col("p"), globs)) == [
        True, True, True, True, False, True, True, False, True, False]
    assert values(spark, [(p,) for p in paths], "p STRING", path_matches(F.col("p"), ["*.snap"], folders=False)) == [
        False, False, True, False, False, False, False, False, False, False]
    assert values(spark, [("a",)], "p STRING", path_matches(F.col("p"), [])) == [False]
    assert glob_to_regex("old/") == "(^|/)old/.*($|/)"
    assert glob_to_regex("./q?r[2].*") == r"(^|/)q[^/]r\[2\]\.[^/]*($|/)"
    assert glob_to_regex("\t ") is None


def test_generated_and_language(spark):
    paths = ["w/node_modules/y/i.js", "cart.spec.tsx", "LIB.MIN.CSS", "out.map", "out.map\n", "app/assets/logo.ts", "lib/cart.ts",
             "cart.d.ts", "cart.vue", "bin/run.dart", "Rakefile", "cart.TS"]
    assert values(spark, [(p,) for p in paths], "p STRING", is_generated(F.col("p"))) == [
        True, True, True, True, False, True, False, True, False, False, False, False]
    assert values(spark, [(p,) for p in paths[-6:]], "p STRING", language_of(F.col("p"))) == [
        "typescript", None, "html", "flutter", None, None]
    urls = ["https://git.example/team/tool.git", "git@git.example:kit.git", "https://git.example/team/bare/"]
    assert values(spark, [(u,) for u in urls], "u STRING", repo_name(F.col("u"))) == ["tool", "git@git.example:kit", "bare"]


def test_suppression(spark):
    rows = [("run(); /* lens-ignore */", ""), ("# lens-ignore: known", None), ("run(2);", "# lens-disable-next-line why"),
            ("run(3);", "run(2); // lens-ignore"), ("run(4) // lens-disable-line", ""), ("lens-ignoring()", "")]
    assert values(spark, rows, "l STRING, p STRING", is_suppressed(F.col("l"), F.col("p"))) == [True, True, True, False, True, False]
    own = Markers(("hush",), ())
    assert values(spark, [("run(5) // hush", "")], "l STRING, p STRING", is_suppressed(F.col("l"), F.col("p"), own)) == [True]


def test_sample_credentials(spark):
    rows = [("user: rod / koala", "conf.yml"), ("login scott/tiger here", ""), ("pw = 'f8Jq0zPl2mN4'", "conf.yml"),
            ("# placeholder pw", "run.rb"), ("pw = 'placeholder'", "run.rb"), ("<pw>dummy</pw>", "conf.xml"), ("pw: dummy", "intro.md"),
            ("end of example */ pw", "run.rb"), ("exemplary // pw", "run.rb")]
    assert values(spark, rows, "l STRING, p STRING", is_sample_credential(F.col("l"), F.col("p"))) == [
        True, True, False, True, False, True, True, True, False]


def test_subjects(spark):
    subjects = ["feat: x", "feat(core): x", "feat!: x", "feature: x", "fix : x", "ci(a)(b): x", None]
    assert values(spark, [(s,) for s in subjects], "s STRING", c.is_conventional(F.col("s"))) == [
        True, True, False, False, False, True, False]
    tickets = ["ABC-12", "a #4", "A-1", "x", "ise-101 y", None]
    assert values(spark, [(s,) for s in tickets], "s STRING", c.has_ticket(F.col("s"))) == [True, True, False, False, True, False]
    assert values(spark, [(1, 8), (0, 0), (1, 3), (2, 3)], "a INT, b INT", c.percentage(F.col("a"), F.col("b"))) == [13, 0, 33, 67]


def test_git_grade(spark):
    rows = [(69, 3, 0), (0, 0, 0), (30, 100, 100), (30, 68, 0), (100, 100, 0)]
    got = values(spark, rows, "a INT, b INT, c INT", c.git_grade(F.col("a"), F.col("b"), F.col("c")))
    assert got[0] in ("B-", "B", "B+") and got[1:] == ["D", "A", "A-", "A"]


def test_code_grade(spark):
    rows = [(130, 40800), (0, 50), (2, 50), (1000, 10), (5, -3)]
    got = values(spark, rows, "s INT, n INT", code_grade(smell_density(F.col("s"), F.col("n"))))
    assert got == ["A-", "A", "B+", "D", "B"]


def test_report_text(spark):
    assert values(spark, [(999,), (1000,), (1250,), (1449,), (1450,), (5600,), (12345678,)], "n INT", r.format_k(F.col("n"))) == [
        "999", "1.0k", "1.3k", "1.4k", "1.4k", "5.6k", "12345.7k"]
    halves = [n for n in range(1050, 60_000, 100) if n % 500 != 250]
    assert values(spark, [(n,) for n in halves], "n INT", r.format_k(F.col("n"))) == [f"{n / 1000:.1f}k" for n in halves]
    assert values(spark, [("A-",), ("",), (None,), ("D",), ("E",)], "g STRING", r.grade_class(F.col("g"))) == ["a", "x", "x", "d", "x"]
    assert values(spark, [("M. Younas",), ("Ann Lee Kim",), ("Bo",)], "n STRING", r.short_name(F.col("n"))) == ["M. Younas", "Ann", "Bo"]
    assert values(spark, [("Ann  Lée!",), ("-x-",)], "n STRING", r.slug(F.col("n"))) == ["ann-l-e", "x"]
    long = "x" * 200
    assert values(spark, [("\t ab \t",), (long,)], "s STRING", r.clip(F.col("s"))) == ["ab", "x" * 160 + "…"]
    day = F.lit("2026-09-17").cast("date")
    assert values(spark, [("2026-07",), ("2025-12",)], "m STRING", r.month_label(F.col("m"), day)) == ["Jul", "Dec '25"]
    assert values(spark, [("12",), ("0",), ("—",), ("3 (x)",), ("900",)], "s STRING", r.cell_intensity(F.col("s"))) == [0.21, None, None, 0.1, 0.7]
    assert values(spark, [(5, 10), (0, 10), (10, 10)], "a INT, b INT", r.heat_intensity(F.col("a"), F.col("b"))) == [0.57, None, 1.0]


def test_staleness(spark):
    days = ["2026-08-27", "2026-08-26", None]
    got = values(spark, [(d,) for d in days], "d STRING", r.is_stale(F.to_date("d"), F.lit(datetime.date(2026, 9, 17))))
    assert got == [False, True, None]


def test_sast_mapping(spark):
    rows = [("a.dom-based-xss", None, "ERROR"), ("b.raw-sql", None, "WARNING"), ("c.redos", None, "INFO"), ("d", "reads the clipboard", None),
            ("e", "Denial of Service", "X"), ("f", "odd", "INFO"), (None, "use of eval here", "ERROR"), (None, "regexp", "ERROR")]
    none = F.lit(None).cast("array<string>")
    assert values(spark, rows, "a STRING, b STRING, c STRING", sast_vector(F.col("a"), F.col("b"), F.lit(None).cast("string"), none, none)) == [
        "Injection/XSS", "Injection/XSS", "ReDoS", "Clipboard", "LPDoS", "SAST (other)", "Injection/XSS", "SAST (other)"]
    assert values(spark, rows, "a STRING, b STRING, c STRING", sast_severity(F.col("c"))) == [
        "High", "Medium", "Low", "Medium", "Medium", "Low", "High", "High"]
