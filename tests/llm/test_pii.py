import random
import re

import pytest
from pyspark.sql import functions as F

from repolens.llm.pii import best_of_overlapping, groups, checked_spans, luhn, proposed_spans, redacted, scan, train, with_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def plain_spans(text):
    def good(kind, value):
        n = sum(c.isdigit() for c in value)
        return {
            "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= n <= 19 and plain_luhn(value), "phone": 9 <= n <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


PIECES = [
    "a", "b.c", "@", ".", "x@y.z", "+", "d@e.f.g", "-", "1", "22", "192.168.0.1", "1.2.3", "256.1.1.1", "0255.0.0.1", " ",
    "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+49", "(0)", "é", "\n", "%", "_", "9" * 25, "+12345678",
]


def test_checked_spans_equal_the_plain_patterns(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "1" * 50_000, "1 " * 30_000, "a" * 100_000, "a." * 30_000 + "@", "+1" * 5_000, "x@y.z " * 700]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(4)
    for r in rows.select("text", checked_spans(F.coalesce("text", F.lit(""))).alias("s")).collect():
        if r["text"] is None or len(r["text"]) < 50_000:
            assert [tuple(s) for s in r["s"]] == plain_spans(r["text"]), r["text"]


def test_luhn(spark):
    values = ["0", "18", "4111111111111111", "4111-1111-1111-1112", "79927398713"]
    rows = spark.createDataFrame([(v,) for v in values], "v STRING").select("v", luhn(F.col("v")).alias("ok")).collect()
    assert all(r["ok"] == plain_luhn(r["v"]) for r in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 1000])
def test_running_combination(spark, n):
    row = spark.range(1).select(F.lit(list(range(n))).cast("array<int>").alias("a")).select(
        scan(F.col("a"), F.lit(0), lambda a, b: a + b).alias("s")).first()
    assert row["s"] == [sum(range(k)) for k in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return train(spark)


def test_model_tells_candidates_apart(spark, model):
    wanted = ["call 555-867-5309 now", 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "card 9807 9157 6280 4491 ok",
              "mail john.smith (at) example.org"]
    left = ["order 12345678 came", "on 2024-01-31 it", "isbn 9783161484 book", "the etaoinshrdluetaoinsh1 x", "plain words", None]
    rows = spark.createDataFrame([(t,) for t in wanted + left], "text STRING")
    found = {r["text"]: r["s"] for r in rows.select("text", proposed_spans(F.coalesce("text", F.lit("")), model).alias("s")).collect()}
    assert all(found[t] for t in wanted), found
    assert not any(found[t] for t in left), found


# Two numbers in a row, dates and addresses beside numbers, accounts, spelled-out addresses, dates of birth: the text and what goes.
LINES = {
    "call order 12345678 555-867-5309 now": ["555-867-5309"],
    "on 2024-01-31 555-867-5309": ["555-867-5309"],
    "2024-01-31 10.0.0.1": [],
    "iban DE89 3704 0044 0532 0130 00 please": ["DE89 3704 0044 0532 0130 00"],
    "mail john (AT) acme (DOT) com": ["john (AT) acme (DOT) com"],
    "she was born 1984-03-12 in": ["1984-03-12"],
    "released on 2014-03-12 in": [],
    "phone (555) 867-5309 or": ["(555) 867-5309"],
    "card 4111 1111 1111 1234 and": ["4111 1111 1111 1234"],
}


@pytest.mark.parametrize("line", LINES)
def test_overlapping_candidates(spark, model, line):
    row = spark.createDataFrame([(line,)], "text STRING").select("text", proposed_spans(F.col("text"), model).alias("s")).first()
    covered = set().union(*[range(s["start"], s["end"]) for s in row["s"]])
    want = set().union(*[range(line.index(v), line.index(v) + len(v)) for v in LINES[line]])
    assert covered == want, row["s"]


def test_groups_of_numbers(spark):
    def of(value):
        match = F.struct(F.lit(value).alias("value"), F.lit(5).alias("start"), F.lit(5 + len(value)).alias("end"))
        return [(g["start"] - 5, g["value"]) for g in spark.range(1).select(groups(match).alias("g")).first()["g"]]

    assert of("12 3456 78901") == [(0, "12 3456 78901"), (3, "3456 78901")]
    assert of("2024-01-31 555-867-5309") == [(11, "555-867-5309")] and of("10.0.0.1 1234567") == [(9, "1234567")]
    assert of("12345678901234567890 1234567") == [(21, "1234567")]
    assert len(of(" ".join("1" * 400))) <= 400 * 13


def test_the_better_of_two_stays(spark):
    rows = [(0, 4, 1.0), (2, 6, 2.0), (6, 8, 0.5), (9, 12, 1.0), (9, 14, 1.0)]
    scored = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("above")) for a, b, s in rows])
    kept = spark.range(1).select(best_of_overlapping(scored).alias("k")).first()["k"]
    assert [(k["start"], k["end"]) for k in kept] == [(2, 6), (6, 8), (9, 14)]


def test_long_rows_of_numbers(spark, model):
    texts = ["1 " * 3_000, "123 " * 2_000, "call 555-867-5309 " * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING").select(proposed_spans(F.col("text"), model).alias("s")).collect()
    assert len(rows[2]["s"]) == 500


def test_redaction(spark, model):
    rows = [
        (1, "é mail x@y.org or +1 (017) 555-7713, ip 10.0.0.1."), (1, None), (None, ""), (2, "clean"), (2, "clean"),
        (3, " ".join(f"u{k}@x.org" for k in range(300)))]
    docs = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id LONG, text STRING, pii_spans STRING")
    found = with_pii(docs.drop("pii_spans"), model)
    texts = sorted(r["text"] or "" for r in redacted(found).collect())
    assert texts == sorted([
        "é mail [EMAIL] or [PHONE], ip [IP].", "", "", "clean", "clean", " ".join(["[EMAIL]"] * 300)])
    assert with_pii(docs, model).columns == ["doc_id", "text", "base_spans", "pii_spans"]
    assert redacted(with_pii(docs.limit(0), model)).count() == 0


def test_overlaps_become_one(spark):
    spans = "array(named_struct('kind','card','start',2,'end',6), named_struct('kind','ip','start',4,'end',8), " \
            "named_struct('kind','phone','start',2,'end',5), named_struct('kind','email','start',9,'end',10))"
    row = spark.range(1).select(F.lit("0123456789x").alias("text"), F.expr(spans).alias("pii_spans"))
    assert redacted(row).first()["text"] == "01[CARD]8[EMAIL]x"


def test_no_python_in_the_plan(spark, model):
    docs = spark.createDataFrame([(1, "a")], "doc_id LONG, text STRING")
    plan = with_pii(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Exchange", plan)
